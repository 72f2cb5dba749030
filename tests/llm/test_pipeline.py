"""The pipeline's stages, each held against what it must leave of its input."""

import itertools
import random
import re

import corpus_pipeline
from casewright.llm import packing, pii
from casewright.llm.common import staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def similar_pairs(texts):
    """Pairs of ids whose five-word sets are alike, by brute force."""
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else {()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, docs, sf_dir))
        if k < 4:
            assert out.columns == docs.columns
        sizes.append(out.count())
        if k == 1:  # one document of each class stays, and all that are like no other
            before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
            assert not similar_pairs(after)
            pairs = similar_pairs(before)
            assert set(before) - {x for p in pairs for x in p} <= set(after) and all(min(p) in after or any(min(p) in q and min(q) < min(p) for q in pairs) for p in pairs)
        if k == 2:
            assert sizes[2] == sizes[1] and out.where("text like '%@%.example.com%'").count() == 0
        docs = out
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert 0 < sizes[1] < sizes[0]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").limit(20).collect()]
    encode = packing.encoder()
    assert all(encode(t)[-1] == 0 for t in texts)


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n))
    same, long = text(60), text(9000)
    rows = [(1, same, "en", "a"), (1, same, "en", "a"), (2, same + " end", "en", None), (None, text(40), None, "b"), (3, None, "en", "a"), (4, "", "en", "b"), (5, long, "en", "b"), (6, "mail bob.x@example.org now " + text(30), "de", "a"), (7, "short one", "en", "a")]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, mark int"
    for name, data in (("odd", [(i, t, lang, s, len(t or ""), "r", 1) for i, t, lang, s in rows]), ("none", [])):
        spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} <= {1, 2, None, 5, 6} and {r.doc_tokens for r in got if r.doc_id == 5} <= {len(packing.encoder()(long))}
    assert all(r.offset + r.length <= 1024 for r in got)
    assert pii.redact(spark.createDataFrame([(6, rows[7][1])], "doc_id int, text string")).first().text.startswith("mail [EMAIL] now ")
