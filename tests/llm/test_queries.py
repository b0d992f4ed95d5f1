"""The queries of the training-data operators against their SQL, and the pipeline against a brute-force version."""

import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hindsight.llm import chat, common, jaccard, quality, registry, secrets, tokenbin, urls, warc

from ..test_oracles import TABLES, rows
from .test_operators import WORD_BPE, brute_leaks, ids_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op1_token_planes", "op3_quality", "op6_bpe"])
def test_one_row_for_each_document(spark, name):
    """Queries beyond SQL leave no document out."""
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    got = registry.QUERIES[name](spark, SF).select("doc_id")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def voted(model, text):
    """The share of label 1 among the k nearest, and all that tie with the last of them."""
    cosine = [round(float(v @ model.latent(quality.features(pa.array([text], pa.string())))[0]), 5) for v in model.vectors]
    last = sorted(cosine)[-min(model.k, len(cosine))]
    w = {i: np.exp((c - max(cosine)) / model.width) for i, c in enumerate(cosine) if c >= last}
    return sum(x * model.labels[i] for i, x in w.items()) / sum(w.values())


def test_op3_votes_are_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (10**9, 1, 0)], labels.schema))
    few = docs.select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(None, "a b"), (7, None), (7, ""), (8, "word " * 30_000)], "doc_id long, text string"))
    few = few.withColumn("score", F.lit("x")).withColumn("quality", F.lit(9))
    model = quality.train(docs, labels)
    out = quality.scored(few, model, "doc_id", "text").collect()
    assert len(out) == 64
    for r in out:
        assert r.score == pytest.approx(voted(model, r.text), abs=1e-3)


def test_op3_learns_nothing_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.scored(docs, quality.train(docs, x), "doc_id").collect()} for x in (labels, flipped))
    assert a == b


def masked(text):
    """A text with the secrets of all rules masked, by Python's patterns."""
    spans = []
    for r in secrets.RULES:
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.value]) >= r.least:
                spans.append((m.end() - len(m[r.value]), m.end()))
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:] if spans else text


def brute_pipeline(spark, docs, labels, items):
    """(doc_id, text) of what run() keeps, masked, and how many rows each stage left."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    model = quality.train(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = [r for r in docs if voted(model, r[1]) >= 0.7]
    left = [len(docs), len(kept)]
    sets = []
    for r in kept:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(kept)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(kept):
        if sets[i]:
            k = find(i)
            if k not in best or ((r[0] is None, r[0] or 0)) < ((kept[best[k]][0] is None, kept[best[k]][0] or 0)):
                best[k] = i
    kept = [r for i, r in enumerate(kept) if not sets[i] or i in best.values()]
    left.append(len(kept))
    leaking = {i for i, *_ in brute_leaks([(i, r[1]) for i, r in enumerate(kept)], items)}
    kept = [r for i, r in enumerate(kept) if i not in leaking]
    left.append(len(kept))
    return [(r[0], masked(r[1])) for r in kept], left


def test_pipeline_is_brute_force(spark, tmp_path):
    g = random.Random(9)
    vocabulary = ["".join(g.choices("aeioulnrst", k=g.randrange(3, 9))) for _ in range(120)]
    text = lambda n: " ".join(g.choices(vocabulary, k=n)).capitalize() + "."
    items = [(i, text(g.randrange(12, 25))) for i in range(6)] + [(2, text(14)), (7, None), (8, "")]
    base = [text(g.randrange(20, 60)) for _ in range(8)]
    docs = []
    for i in range(150):
        t = text(g.randrange(15, 60))
        if i % 5 == 0:
            t = " ".join(["BUY NOW!!!"] * g.randrange(4, 20)) + " CLICK >>> " + text(3).upper()
        elif i % 5 == 1:  # copies and near copies
            w = g.choice(base).split()
            if g.random() < 0.6:
                w[g.randrange(len(w))] = g.choice(vocabulary)
            t = " ".join(w)
        elif i % 7 == 2:
            w = items[g.randrange(6)][1].split()
            t = f"{t} {' '.join(w[5:])} {text(4)} {' '.join(w[:5])}"
        elif i % 7 == 3:
            t = f"{t} api_key = '{'Ab3_' * 4}' {text(3)} AKIA{'Q' * 18} eyJ{'a' * 9}.{'b' * 9}.{'c' * 9}"
        docs.append((i, t, "en", "web", len(t)))
    docs += [docs[2], docs[2], (None, text(30), "en", None, 1), (None, items[0][1], None, "web", None), (None, "", "en", "web", 0), (None, "", "en", "web", 0), (400, None, "en", "web", None), (401, "", "en", "web", 0), (3, text(25), "en", "web", 5), (3, items[1][1] + " and more", "en", "web", 5), (402, text(9000), "en", "web", 1), (403, "x" * 50_000, "en", "web", 1)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(150) if i % 2] + [(i, 0, 0) for i in range(0, 150, 10)] + [(None, 1, 0), (1, None, None)]
    for name, data, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    want, left = brute_pipeline(spark, docs, labels, items)
    assert left == sorted(left, reverse=True) and len(set(left)) == 4
    tok = Tokenizer.from_file(WORD_BPE)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.ids_sha256) for r in out), key=key) == sorted(((d, digest(ids_of(tok, t))) for d, t in want), key=key)
    assert all(len(r.ids) == r.n_tokens and r.ids_sha256 == digest(r.ids) and hashlib.sha256(tok.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() == r.decoded_sha256 for r in out)


def test_pipeline_of_no_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"Some words of text number {i} that stand here alone, {i * 7} of them.", "en", "a", 9, "x", 1.0) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long, row string, score double").withColumns({"key": F.lit(1), "words": F.lit("w"), "node": F.lit(2), "blob": F.lit("b"), "doc": F.lit("d")})
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name


def test_op1_repeated_ids_in_many_partitions(spark):
    texts = [f"word{i} and more" for i in range(40)]
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = sorted(tokenbin.read_shards(tokenbin.write_shards(docs, common.new_dir(spark, "t1"), WORD_BPE, block=16)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i % 3 for i in range(40))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(40)]


def test_op2_ties_and_unknown_kinds(spark):
    schema = "conv_id long, slot long, seq long, kind string, role string, text string"
    tied = [(1, 0, 5, "delta", "user", "B"), (1, 0, 5, "edit", "user", "A"), (1, 0, 5, "message", "user", "gone"), (1, 0, 5, "delta", "user", "C")]
    got = [(r.role, r.text) for r in chat.reconstruct(spark.createDataFrame(tied, schema)).collect()]
    assert got == [("user", "ABC")]
    bad = [(1, 0, 9, "regenerate", "assistant", "x"), (1, 1, 1, "swap", "user", "y")]
    with pytest.raises(Exception, match="unknown kind"):
        chat.reconstruct(spark.createDataFrame(bad, schema)).collect()


def test_op2_logs_use_every_kind(spark):
    rows_ = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", f"text {c} {t} é😀</s>" * (t % 3)) for c in range(40) for t in range(6)] + [(0, 2, "user", "again"), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, None, None, None)], "conv_id long, turn long, role string, text string")
    log = chat.logged(rows_)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    got = sorted((r.conv_id or -1, -1 if r.slot is None else r.slot, r.role, r.text) for r in chat.reconstruct(log).collect())
    assert got == sorted((r.conv_id or -1, -1 if r.turn is None else r.turn, r.role or "", r.text or "") for r in rows_.collect())


def test_op4_long_hostile_texts_take_linear_time(spark):
    hostile = ["eyJ" * 400_000, "eyJaaaaaaaaa." * 80_000, "AKIA" * 200_000, "token" * 200_000, "password" + " " * 900_000, "-----BEGIN " * 90_000, "0123456789abcdef" * 1 + "0123456g" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(hostile)], "doc_id long, text string").repartition(4)
    began = time.time()
    assert secrets.findings(df, common.new_dir(spark, "t4")).count() == len(hostile)
    assert time.time() - began < 60


def test_op4_jwt_starts_at_the_run(spark):
    jwt = f"eyJ{'a' * 9}.{'b' * 9}.{'c' * 9}"
    df = spark.createDataFrame([(1, jwt), (2, f"x{jwt}"), (3, f"({jwt} {jwt}"), (4, f"a.{jwt}")], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.findings] for r in secrets.findings(df, common.new_dir(spark, "t4")).collect()}
    n = len(jwt)
    assert got == {1: [(0, n)], 2: [], 3: [(1, 1 + n), (2 + n, 2 + 2 * n)], 4: [(2, 2 + n)]}


def test_op8_windows_and_areas_are_exact(spark):
    """Sizes from one to hundreds of tokens that share frequent phrases, near copies of near copies, and supersets."""
    g = random.Random(21)
    phrases = [" ".join(g.choices([f"q{i}" for i in range(30)], k=g.randrange(4, 12))) for _ in range(12)]
    texts = [" ".join(g.choices(phrases, k=g.randrange(1, 30))) for _ in range(70)]
    chain = [f"c{i}" for i in range(60)]
    for i in range(70):
        chain = list(chain)
        chain[g.randrange(60)] = f"d{i % 9}"
        texts.append(" ".join(chain if i % 3 else chain + [f"e{k}" for k in range(g.randrange(8))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} for w in map(str.split, texts)]
    for share in (80, 90):
        root = list(range(len(texts)))
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        got = {r.doc_id: r.component_id for r in jaccard.near_groups(df, 2, share, heavy=20, small=3, salts=4).collect()}
        assert got == {i: find(i) for i in range(len(texts))}
        assert 5 < len(set(got.values())) < len(texts)


def test_op9_columns_that_clash_and_ties_between_lists(spark):
    e = [("b", "domain", "x.com", "block", "add", 1), ("a", "domain", "x.com", "block", "add", 1), ("c", "domain", "x.com", "allow", "add", 1)]
    entries = spark.createDataFrame(e, "list string, kind string, pattern string, verdict string, action string, at long")
    cap = spark.createDataFrame([("http://x.com/", 5, "h", "l", 7)], "url string, fetched_at long, host string, list string, slab int")
    r = urls.judged(cap, entries).first()
    assert (r.verdict, r["list"], r.host, r.slab) == ("block", "a", "x.com", 7)


def test_op10_long_and_empty_pages(spark):
    rows_ = [(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), *((i, None, None) for i in range(3, 200)), (5, "v", "")]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, common.new_dir(spark, "t10"))).toPandas()
    assert len(got) == 200 and (got.payload_bytes > 0).sum() == 2
    assert sorted(got[got.payload_bytes > 0].record_type) == ["response", "revisit"] and set(got[got.payload_bytes == 0].record_type) == {"response"}
    assert pd.isna(got[got.page_id == 1].refers_to).all() and (got[got.page_id == 2].refers_to == 1).all()


def test_work_folders_without_a_scheme(spark):
    assert common.qualified(spark, "/tmp/plain/") == "file:///tmp/plain"
    assert common.qualified(spark, "hdfs://name/x/") == "hdfs://name/x"
    assert "://" in common.shared_dir(spark)


def test_op2_turns_of_any_size(spark):
    """Extreme, negative, null and repeated turns: each message comes back once, in order."""
    edge = [-(2**63), -(2**58) - 1, -16, -1, 0, 1, 2**56, 2**57, 2**58 + 5, 2**58 + 6, 2**63 - 2, 2**63 - 1]
    rows_ = [(c, t, ("user", "assistant")[i % 2], f"text {c} {t}") for c in range(40) for i, t in enumerate(edge)]
    rows_ += [(50, None, "user", "a"), (50, None, "user", "b"), (50, 3, "user", "c"), (50, 3, "user", "c"), (None, 1, "user", "x"), (None, 1, "user", "y"), (51, 2**63 - 1, None, None)]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("slot", F.lit(1)).withColumn("n", F.lit("n"))
    got = chat.reconstruct(chat.logged(df)).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((key(r.conv_id), r.role, r.text) for r in got) == sorted((key(c), r or "", t or "") for c, _, r, t in rows_)
    for c in range(40):
        assert [r.text for r in sorted((r for r in got if r.conv_id == c), key=lambda r: (r.slot, r.nth))] == [f"text {c} {t}" for t in edge]
