"""The pipeline against a plain version: each rule in a few lines of Python, one document after another."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import linked
from tests.llm.test_near_dup import brute as groups
from tests.llm.test_quality_rules import brute as measures


def corpus():
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 8))) for _ in range(500)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, line(14)) for i in range(5)]
    docs = [(i, "\n".join(line(r.randint(12, 30)) for _ in range(3))) for i in range(60)]
    n = len(docs)
    for i in range(6):
        docs.append((n + i, docs[i][1]))  # copies
        docs.append((n + 10 + i, docs[i][1].replace("a", "e", 1)))  # one edit
        w = docs[10 + i][1].split(" ")
        w[5] = "changedword"
        docs.append((n + 20 + i, " ".join(w)))  # a word replaced
        docs.append((n + 30 + i, docs[20 + i][1] + "\n" + bench[i % 5][1]))
        docs.append((n + 40 + i, "same words again and " * 12))
    return docs + [(900, None), (901, ""), (902, "short text")], bench


def plain(docs, bench):
    docs = [(d, t) for d, t in docs if not measures(t)[5]]  # too few labels to certify a cutoff
    seen, out = [], []
    for d, t in sorted(docs):
        kept = []
        for x in t.split("\n"):
            if x.strip(" \t\n\x0b\f\r"):
                near = any(x == y or linked(x, y) for y in seen)
                seen.append(x)
                if near:
                    continue
            kept.append(x)
        if any(re.search(r"\S", x) for x in kept):
            out.append((d, "\n".join(kept)))
    keep = {g[0] for g in groups(out, 5) if g[3]}
    out = [(d, t) for d, t in out if d in keep]
    bad = {x[0] for x in leaks(out, bench) if x[5]}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sorted((d, tok.encode(t, add_special_tokens=False).ids) for d, t in out if d not in bad)


def test_pipeline_matches_the_plain_version(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in docs[:50]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain(docs, bench)
    assert sorted((r.doc_id, r.ids) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got) and 40 < len(want) < len(docs)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, bench = corpus()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df.limit(0), str(tmp_path)).columns == df.columns
    assert len(corpus_pipeline.STAGES) == 5
