"""The pipeline against the operators' brute forces, stage by stage."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import DOCS, WORDS, brute_components, brute_pieces, check_packed
from tokenizers import Tokenizer

from tessella.llm.queries import vocabulary


def corpus(spark, path):
    r = random.Random(21)
    rows, labels = [], []
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    for i in range(240):
        words = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[3:3] = ["grobian", "schuft"]
        if i % 10 == 1:
            words[6:6] = ["token", "=", f'"{key()}"']
        rows.append([i, " ".join(words), "en", r.choice(["a", "b", "c"]), 0])
        labels.append((i, 1, int(toxic)))
    for i in range(240, 270):  # near copies
        rows.append([i, rows[i - 239][1] + " end", "en", "a", 0])
    rows += [[270, None, None, None, None], [271, "", "en", "a", 0], [272, "Gr0bian und 5chuft", "de", "b", 0]]
    spark.createDataFrame([tuple(x) for x in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {x[0]: x for x in rows}


def test_stages(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    kept, tables = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path)).cache()
        tables.append(kept)
    clean, single, redacted, mixed, packed = tables
    assert all(t.columns == names for t in tables[:4])
    bad = {i for i, x in rows.items() if x[1] and re.search("grobian|schuft|Gr0bian", x[1])}
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(left) == set(rows) - bad
    comp = brute_components(left.items(), 5, 80, 100)
    heads = {r["doc_id"] for r in single.collect()}
    assert heads == {i for i, (_, c) in comp.items() if c == i} and len(heads) < len(left)
    after = {r["doc_id"]: r["text"] for r in redacted.collect()}
    for i in heads:
        assert after[i] == (re.sub(r'token = "[0-9a-f]{40}"', 'token = "<secret>"', left[i]) if left[i] is not None else None)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= heads and max(copies.values()) <= 3
    words = sum(len((after[i] or "").split()) for i in after)
    assert abs(sum(n * len((after[i] or "").split()) for i, n in copies.items()) - words) <= 0.05 * words
    exact = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter((i, *p) for i, n in copies.items() for p in brute_pieces(after[i], exact) for _ in range(n))
    got = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_packed(got)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))
    assert Counter(map(key, whole)) == Counter(map(key, got))


def test_stages_keep_other_columns(spark, tmp_path):
    corpus(spark, str(tmp_path))
    extra = {c: F.lit(c) for c in ("component_id", "copies", "row", "size", "u", "score", "kept_id", "source_size", "text2", "label")}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns(extra)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.select(*extra).distinct().collect() == [tuple(extra)]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == docs.count()


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
