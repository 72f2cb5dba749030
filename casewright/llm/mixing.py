"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is to be taken target / source size times; the whole
part is certain, the fraction is rounded. Two documents with fractional shares
play against each other: words move from one to the other until one share is 0
or 1, in a random direction whose odds keep each share's expectation (Deville
and Tille, 1998; the mass moved is words, so a source's words are kept exactly,
whatever the sizes). What stays fractional, one document a group, is combined
in groups of groups, a reduction tree whose depth is the logarithm of the
documents; only the root's single document a source is rounded on its own.

That document can be as long as any, so long documents are settled first: the
tree is run for each tier of sizes (TIERS), and what a tier's last document was
rounded off by is added to the shares of the next, shorter tier, evenly. So a
source misses its target by a document of the last tier, if that has the words.

Documents that are alike play against each other first: n of them with a
fraction f each end as the whole part of n * f that are taken once more, and one
with the rest of it. So alike rows are one row with a count, however many they
are, and a group of the tree holds about GROUP different ones.

Chance is a hash of the ids, so reruns agree. Built-in functions only.

Defined cases: a null text has size 0; documents of size 0 are taken the whole
part of times, and once more by a hash; a null source is a source of its own,
the last; repeated rows are documents of their own; an empty table gives no
rows; the named columns alone are read, and `mix` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, n_words, numbered, repeated, row_mark, skew_join, staged, uniform

WEIGHTS = (5, 2, 1)
#: Documents of a group, and groups' rests in a group of the next level.
GROUP = 256
#: The least size of a document of each tier but the last, longest first.
TIERS = (4096, 512, 64)
_DOC = "struct<id:bigint,mark:bigint,size:bigint,mass:double,kept:struct<number:bigint,source_size:bigint,target:double,rows:bigint,whole:bigint,certain:bigint>>"
_KEPT = ("number", "source_size", "target", "rows", "whole", "certain")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, number, source_size, n_docs, target from rows of (source, size, rows).

    Sources are numbered by code point, nulls last, from 0. The excess of capped
    targets is shared anew by weight until none is above its cap: each round
    adds up a few numbers over the sources.
    """
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.sum("rows").alias("n_rows"))
    s = numbered(sums, [F.col("source").asc_nulls_last()])
    s = staged(s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))))
    total = share * float(s.agg(F.sum("source_size")).first()[0] or 0)
    full = F.col("source_size") * F.lit(cap)
    level, capped = None, -1
    while True:
        below = F.lit(False) if level is None else full <= F.col("weight") * F.lit(level)
        taken, left, count = s.agg(F.sum(F.when(below, full).otherwise(0.0)), F.sum(F.when(below, 0.0).otherwise(F.col("weight"))), F.count_if(below)).first()
        if count == capped or not left:
            break
        level, capped = (total - taken) / left, count
    target = full if level is None else F.least(full, F.col("weight") * F.lit(level))
    return s.select("source", "number", "source_size", "n_docs", "n_rows", target.cast("double").alias("target"))


def _play(docs: Column, seed: int) -> Column:
    """A struct of the settled documents and of what is left of one fractional one.

    `docs` is an array of _DOC with masses strictly between 0 and their size.
    """
    doc = lambda d, mass: F.struct(*[d[c].alias(c) for c in ("id", "mark", "size")], mass.alias("mass"), d["kept"].alias("kept"))
    start = F.struct(F.lit(None).cast(_DOC).alias("held"), F.array().cast(f"array<{_DOC}>").alias("done"))

    def meet(s: Column, d: Column) -> Column:
        held = s["held"]
        up = F.least(held["size"] - held["mass"], d["mass"])
        down = F.least(held["mass"], d["size"] - d["mass"])
        luck = uniform(held["id"], held["mark"], d["id"], d["mark"], F.lit(seed)) * (up + down) < down
        moved = F.when(luck, up).otherwise(-down)
        snap = lambda x, mass: F.when(mass <= 1e-6, 0.0).when(mass >= x["size"] - 1e-6, x["size"].cast("double")).otherwise(mass)
        both = F.array(doc(held, snap(held, held["mass"] + moved)), doc(d, snap(d, d["mass"] - moved)))
        settled = lambda x: (x["mass"] == 0.0) | (x["mass"] == x["size"])
        after = lambda b: F.struct(F.get(F.filter(b, lambda x: ~settled(x)), F.lit(0)).alias("held"), F.concat(s["done"], F.filter(b, settled)).alias("done"))
        return F.when(held.isNull(), F.struct(d.alias("held"), s["done"].alias("done"))).otherwise(let(both, after))

    return F.aggregate(docs, start, meet)


def alike(rows: DataFrame) -> DataFrame:
    """id, mark, source, size and `rows`, the number of rows that are alike in these; counts combine before the shuffle."""
    return staged(rows.groupBy("id", "mark", "source", "size").agg(F.count(F.lit(1)).alias("rows")))


def _settled(docs: DataFrame, most: int, seed: int, group: int) -> list[DataFrame]:
    """Parts of id, mark, size, _KEPT and `copies` of `docs`, which have `share`, what is added to the whole times."""
    # alike documents have played: `certain` of them are taken, and one is left with a fraction
    part = F.col("share") * F.col("rows")
    near = F.round(part)
    d = docs.withColumn("sure", F.when(F.abs(part - near) * F.col("size") <= 1e-6, near).otherwise(F.floor(part)).cast("bigint"))
    d = d.withColumn("mass", (part - F.col("sure")) * F.col("size")).withColumn("certain", F.col("whole") * F.col("rows") + F.col("sure"))
    fractional = (F.col("mass") > 1e-6) & (F.col("mass") < F.col("size") - 1e-6)
    ids = ["id", "mark", "size"]
    out = [d.where(~fractional).select(*ids, *_KEPT, (F.col("certain") + (F.col("mass") > 1e-6).cast("bigint")).alias("copies"))]
    groups = F.greatest(F.ceil(F.col("n_docs") / group), F.lit(1)).cast("bigint")
    level = d.where(fractional).select("number", F.pmod(F.xxhash64("id", "mark", "size", F.lit(seed)), groups).alias("part"), F.struct(*ids, "mass", F.struct(*_KEPT).alias("kept")).alias("doc"))
    parts, depth = -(-most // group), 0
    taken = lambda x, more: [*[x[c].alias(c) for c in ids], *[x["kept"][c].alias(c) for c in _KEPT], (x["kept"]["certain"] + more.cast("bigint")).alias("copies")]
    order = lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).when(a["mark"] < b["mark"], -1).when(a["mark"] > b["mark"], 1).otherwise(0)
    while True:
        played = level.groupBy("number", "part").agg(_play(F.array_sort(F.collect_list("doc"), order), seed + depth).alias("s"))
        played = staged(played.select("number", "part", F.col("s.held").alias("held"), F.col("s.done").alias("done")))
        out.append(played.select(F.explode("done").alias("x")).select(*taken(F.col("x"), F.col("x.mass") > 0)))
        rest = played.where("held is not null")
        if parts <= 1:
            lucky = uniform(F.col("held.id"), F.col("held.mark"), F.lit(seed - 1)) * F.col("held.size") < F.col("held.mass")
            return [*out, rest.select(*taken(F.col("held"), lucky))]
        level = rest.select("number", F.floor(F.col("part") / group).alias("part"), F.col("held").alias("doc"))
        parts, depth = -(-parts // group), depth + 1


def copies(sizes: DataFrame, targets: DataFrame, seed: int = 0, group: int = GROUP, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """id, mark, size, source_size, target, rows and copies, the times that all its rows are taken, for each of `alike`."""
    key = F.xxhash64(F.col("source").isNull(), "source")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = staged(targets.select(key.alias("key"), F.col("source").alias("name"), "number", "source_size", "target", "n_docs", F.floor(times).cast("bigint").alias("whole"), (times - F.floor(times)).alias("part")))
    d = skew_join(sizes.withColumn("key", key), known, "key", "n_docs").where(F.col("source").eqNullSafe(F.col("name")))
    d = staged(d.select("id", "mark", "size", "rows", "number", "source_size", "target", "whole", "part"))
    shown = ["id", "mark", "size", "source_size", "target", "rows", "copies"]
    each = F.col("part") * F.col("rows")
    more = F.floor(each) + (uniform(F.col("id"), F.col("mark"), F.lit(seed)) < each - F.floor(each)).cast("bigint")
    out = d.where("size = 0").withColumn("copies", F.col("whole") * F.col("rows") + more).select(*shown)
    bounds = [*tiers, 1]
    tier = F.lit(len(tiers))
    for k in reversed(range(len(tiers))):
        tier = F.when(F.col("size") >= tiers[k], k).otherwise(tier)
    sums = staged(d.where("size > 0").groupBy("number", tier.alias("tier")).agg(F.sum(F.col("size") * F.col("rows")).alias("mass"), F.count(F.lit(1)).alias("n_docs")))
    most = {r[0]: r[1] for r in sums.groupBy("tier").agg(F.max("n_docs")).collect()}  # a row for each tier
    carry = known.select("number", F.lit(0.0).alias("carry"))
    for k in sorted(most):
        t = d.where((F.col("size") >= bounds[k]) & ((F.col("size") < bounds[k - 1]) if k else F.lit(True)))
        s = known.select("number", "part").join(sums.where(F.col("tier") == k).drop("tier"), "number", "left").join(carry, "number").withColumn("wanted", F.col("part") * F.coalesce("mass", F.lit(0)) + F.col("carry"))
        s = staged(s.withColumn("share", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("wanted") / F.col("mass")))))
        found = _settled(skew_join(t, s.where("mass is not null").select("number", "share", "n_docs"), "number", "n_docs"), most[k], seed + 7919 * k, group)
        settled = found[0]
        for x in found[1:]:
            settled = settled.unionByName(x)
        settled = staged(settled)
        out = out.unionByName(settled.select(*shown))
        got = settled.groupBy("number").agg(F.sum((F.col("copies") - F.col("whole") * F.col("rows")) * F.col("size")).alias("got"))
        carry = s.join(got, "number", "left").select("number", (F.col("wanted") - F.coalesce("got", F.lit(0))).alias("carry"))
    return out


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **sharing) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Of alike rows the first are taken once more; which of them is which can't be
    told from the result.
    """
    sizes = alike(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("mark"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")))
    found = repeated(copies(sizes, source_targets(sizes, **sharing), seed), "rows", most=sizes.agg(F.max("rows")).first()[0] or 0)
    each = F.floor(F.col("copies") / F.col("rows"))
    return found.select(F.col("id").alias(doc_id), "size", "source_size", "target", ((each + (F.col("n") < F.col("copies") - each * F.col("rows")).cast("bigint")) * F.col("size")).cast("bigint").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **sharing) -> DataFrame:
    """The mixture: each document as many times as it is taken, with the columns of `docs`.

    Rows are alike if all their columns are. Each of them is repeated where it
    lies; what n alike rows are taken more than n times the same, fewer than n
    times in all, is made from one of them and dealt to many tasks.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0).cast("bigint")).alias("id"), row_mark(docs).alias("mark"), F.col(source).alias("source"), F.col(text).alias("body"))
    sizes = alike(keyed.select("id", "mark", "source", n_words(F.col("body")).alias("size")))
    found = staged(copies(sizes, source_targets(sizes, **sharing), seed).select("id", "mark", "copies", "rows").where("copies > 0"))
    each = F.floor(F.col("copies") / F.col("rows")).cast("int")
    found = found.withColumn("each", each).withColumn("k", F.col("copies") - F.col("each") * F.col("rows"))
    d = keyed.select("row", "id", "mark")
    out = skew_join(d, found.where("each > 0"), ["id", "mark"], "rows", whole=False).select("row", F.explode(F.sequence(F.lit(1), F.col("each")))).select("row.*")
    some = found.where("k > 0")
    if some.isEmpty():
        return out
    one = skew_join(d, some, ["id", "mark"], "rows", whole=False).groupBy("id", "mark").agg(F.first("row").alias("row"), F.first("k").alias("k"))
    return out.unionByName(repeated(one.select("row", "k"), "k").select("row.*"))
