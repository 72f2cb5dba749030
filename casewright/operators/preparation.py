"""Splits, duplicates, samples and cross tables of labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import collapsed


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of more than one row with the same text but for white space: digest, n, first id."""
    norm = F.md5(collapsed(F.col(text)))
    return docs.groupBy(norm.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def draw(*keys: Column) -> Column:
    """Hex digits that the keys decide; their order is a reproducible shuffle."""
    return F.md5(F.concat_ws(":", *keys))


def stratified_split(families: DataFrame, stratum: str, family: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Each stratum's families, shuffled; the first share of them, one at least, is `test`.

    Families are dealt to slices by the first digits of their draw, so that a
    slice of a stratum, and not the stratum, is sorted by a task; a row for each
    slice says how many families come before it.
    """
    d = families.select(stratum, family).distinct().withColumn("_draw", draw(F.col(family).cast("string"), F.lit(str(seed)))).withColumn("_slice", F.substring("_draw", 1, 2))
    counts = d.groupBy(stratum, "_slice").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows a stratum at most
    whole, before = Window.partitionBy(stratum), Window.partitionBy(stratum).orderBy("_slice")
    counts = counts.select(F.col(stratum).alias("_s"), F.col("_slice").alias("_of"), (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_m"))
    place = F.row_number().over(Window.partitionBy(stratum, "_slice").orderBy("_draw"))
    j = d.withColumn("_at", place).join(counts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_of")))
    take = F.greatest(F.lit(1), F.floor(F.col("_m") * share))
    return j.select(stratum, family, F.when(F.col("_before") + F.col("_at") <= take, "test").otherwise("train").alias("split"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """Exactly n rows of each stratum, or all of a smaller one, in shuffled order."""
    w = Window.partitionBy(stratum).orderBy(draw(F.col(key).cast("string"), F.lit(str(seed))))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(stratum, key, "place")


def leaks(rows: DataFrame, family: str, split: str) -> DataFrame:
    """Families that are in more than one split."""
    return rows.groupBy(family).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """How often each of the values stands in a row's group, and all others, nulls too, in `<column>_other`."""
    other = ~F.coalesce(F.col(column).isin(values), F.lit(False))
    return rows.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values], F.count_if(other).alias(f"{column}_other"))


def audit(cases: DataFrame, case_id: str, family: str, split: str, text: str) -> DataFrame:
    """risk, n: what a set of split cases breaks or has to be told of: missing splits, families in two splits, equal texts, made cases."""
    made = augmentation_type(F.col(case_id)).isin("paraphrase", "polarity")
    one = cases.agg(F.count_if(F.col(split).isNull()).alias("missing split"), F.count_if(made).alias("made cases"))
    two = leaks(cases.where(F.col(split).isNotNull()), family, split).agg(F.count(F.lit(1)).alias("family in two splits"))
    same = exact_duplicates(cases, case_id, text).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("equal texts"))
    d = one.join(two).join(same)
    return d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("risk"), F.col(f"`{c}`").cast("bigint").alias("n")) for c in d.columns])).alias("r")).select("r.*").where("n > 0")


def adversarial_cases(taxonomy: DataFrame, template: str = "{0} {1}", most: int = 20) -> DataFrame:
    """case_id, case_description, code, false_trigger_code and trigger_word: a code's first word in a text that plants a word of the next code.

    The taxonomy is a small table; the `most` codes that come first have a case.
    """
    w = Window.orderBy("code")
    t = taxonomy.where(F.size("keywords") > 0).select("code", F.get("keywords", F.lit(0)).alias("word"))
    t = t.withColumn("n", F.row_number().over(w)).withColumn("false_trigger_code", F.lead("code").over(w)).withColumn("trigger_word", F.lead("word").over(w)).where(F.col("false_trigger_code").isNotNull() & (F.col("n") <= most))
    text = F.replace(F.replace(F.lit(template), F.lit("{0}"), F.col("word")), F.lit("{1}"), F.col("trigger_word"))
    return t.select(F.concat(F.lit("ADV_"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("case_id"), text.alias("case_description"), "code", "false_trigger_code", "trigger_word")


def augmentation_type(case_id: Column, stated: Column | None = None) -> Column:
    """How a case was made, by the marks in its id; else what it states, or `original`."""
    kind = F.when(case_id.startswith("NEG_"), "polarity")
    for mark, name in (("_PAR_", "paraphrase"), ("_ESC_", "complexity_escalation"), ("_SIM_", "complexity_reduction")):
        kind = kind.when(case_id.contains(mark), name)
    return kind.when(case_id.startswith("ADV_"), "adversarial").otherwise(F.coalesce(stated, F.lit("original")) if stated is not None else F.lit("original"))


def case_faults(cases: DataFrame, problems: str = "problems", least: int = 90) -> DataFrame:
    """fault, n: what a set of labelled cases (case_id, case_description, array of structs with code and severity) breaks."""
    p = F.col(problems)
    each = {
        "missing case_id": F.coalesce(F.col("case_id") == "", F.lit(True)), "missing case_description": F.coalesce(F.col("case_description") == "", F.lit(True)), "empty problem_list": F.coalesce(F.size(p) <= 0, F.lit(True)),
        "missing code": F.coalesce(F.exists(p, lambda x: F.coalesce(x["code"] == "", F.lit(True))), F.lit(False)), "missing severity": F.coalesce(F.exists(p, lambda x: x["severity"].isNull()), F.lit(False)),
    }
    one = cases.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in each.items()])
    twice = cases.where("case_id <> ''").groupBy("case_id").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate case_id"))
    names = [*each, "duplicate case_id", "too few cases"]
    d = one.join(twice).withColumn("too few cases", F.greatest(F.lit(least) - F.col("n"), F.lit(0)))
    rows = F.array(*[F.struct(F.lit(k).alias("fault"), F.col(f"`{k}`").cast("bigint").alias("n")) for k in names])
    return d.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def complexity_variants(cases: DataFrame, complication: Column, added: str, problems: str = "problems") -> DataFrame:
    """Harder forms of `simple` cases and easier ones of `complex` cases, with ids that say so.

    Harder: severities one up to 5, `complication` after them if there are any,
    and the text `added`. Easier: the first two problems, severities one down to
    1, and the first three words of the text.
    """
    p = F.col(problems)
    step = lambda by: F.transform(p, lambda x: x.withField("severity", F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(x["severity"], F.lit(1 if by > 0 else 3)) + by))))
    keep = [c for c in cases.columns if c not in ("case_id", "complexity", "case_description", problems)]
    harder = cases.where("complexity = 'simple'").select(*keep, F.concat("case_id", F.lit("_ESC_1")).alias("case_id"), F.lit("complex").alias("complexity"), F.concat(F.coalesce("case_description", F.lit("")), F.lit(added)).alias("case_description"), F.when(F.size(p) > 0, F.concat(step(1), F.array(complication))).otherwise(p).alias(problems))
    easier = cases.where("complexity = 'complex'").select(*keep, F.concat("case_id", F.lit("_SIM_1")).alias("case_id"), F.lit("simple").alias("complexity"), F.array_join(F.slice(F.split("case_description", " "), 1, 3), " ").alias("case_description"), F.slice(step(-1), 1, 2).alias(problems))
    return harder.unionByName(easier)


def paraphrased(cases: DataFrame, synonyms: DataFrame, most: int = 2, seed: int = 42, text: str = "case_description") -> DataFrame:
    """`cases` whose text has some of the words of `synonyms` (word, others), with the first place of up to `most` replaced.

    Which words and which synonyms is decided by the case and the seed; words are
    replaced in the drawn order, so a later one may meet an earlier synonym.
    """
    hit = cases.select("case_id", text).join(F.broadcast(synonyms.where("word <> '' AND size(others) > 0")), F.contains(F.col(text), F.col("word")))
    key = F.md5(F.concat_ws(":", "case_id", "word", F.lit(str(seed))))
    pick = F.element_at("others", (F.pmod(F.xxhash64(key), F.size("others")) + 1).cast("int"))
    drawn = hit.select("case_id", F.struct(key.alias("d"), F.col("word").alias("w"), pick.alias("by")).alias("x")).groupBy("case_id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("_xs"))

    def once(t: Column, x: Column) -> Column:
        at = F.call_function("instr", t, x["w"])
        return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), x["by"], F.substring(t, at + F.length(x["w"]), F.length(t)))).otherwise(t)

    return cases.join(drawn, "case_id").withColumn(text, F.aggregate("_xs", F.col(text), once)).drop("_xs")
