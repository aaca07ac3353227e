"""Operators 6 and 7, the pipeline, and that each query runs and names its columns."""

import itertools
import json

import numpy as np
import pytest

import corpus_pipeline
from ledgerspark.llm import ORACLES, QUERIES, chat, urlrules

SF = "/root/testdata/sf0.001"


def test_urls_by_fixed_rules(spark):
    cases = [
        ("http://A.Example.ORG/en/19?x", "a.example.org", "/en/19", "example.org/en/1", "block"),
        ("x://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://b.com/fr/1#t", "b.com", "/fr/1", "com/fr/", "allow"),
        ("http://b.com/de", "b.com", "/de", None, "allow"),
        ("http://b.com?/de/", "b.com", "", None, "allow"),
        ("http://org", "org", "", None, "allow"),
        ("http://c.net/de/://x", "c.net", "/de/://x", None, "allow"),
        ("ÄÖ://É.COM/fr/", "É.com", "/fr/", "com/fr/", "allow"),
        ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x", i) for i, c in enumerate(cases)] + [(None, None, None, None)] + [(0, cases[0][0], "x", 0)],
                                  "page_id long, url string, host string, rule long")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = urlrules.judge(pages, labels).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:]
    assert urlrules.judge(pages.limit(0), labels).collect() == []


def test_mined_rules_equal_counting(spark):
    rng = np.random.default_rng(5)
    urls, bad = [], []
    for _ in range(600):
        host, part = rng.choice(["spam", "good", "news", "shop"]), rng.choice(["win", "read", "list"])
        urls.append(f"http://{host}.site.net/{part}/{rng.integers(1000)}")
        bad.append(bool(rng.random() < (0.95 if (host, part) == ("spam", "win") else 0.05)))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    tokens = pages.withColumns({"host": urlrules.host_of(F.col("url")), "path": urlrules.path_of(F.col("url"))}).withColumn("tokens", urlrules.tokens())
    sets = {r.page_id: set(r.tokens) for r in tokens.collect()}
    rules = {tuple(r["items"]): (r.confidence, r.support) for r in urlrules.mine(tokens, labels).collect()}
    want = {}
    for n in range(1, 8):
        for some in itertools.combinations(sorted(set().union(*sets.values())), n):
            hit = [i for i, s in sets.items() if s.issuperset(some)]
            both = sum(bad[i] for i in hit)
            if hit and both >= max(urlrules.LEAST, urlrules.SUPPORT * 600) and both / len(hit) >= urlrules.CONFIDENCE:
                if not any(set(w) < set(some) and c >= both / len(hit) for w, (c, _) in want.items()):
                    want[some] = (both / len(hit), both / 600)
    assert rules.keys() == want.keys() and len(want) >= 1
    for k, v in want.items():
        assert np.allclose(rules[k], v)
    judged = {r.page_id: r.verdict for r in urlrules.judge(pages, labels).collect()}
    assert {i for i, v in judged.items() if v == "block"} == {i for i, s in sets.items() if any(s.issuperset(w) for w in want)}


def path_score(p, path, marks, lines):
    return p["start"][path[0]] + sum(p["mark"][r, m + 1] + p["line"][r, x] for r, m, x in zip(path, marks, lines, strict=True)) + sum(
        p["move"][a, b] for a, b in itertools.pairwise(path))


@pytest.mark.parametrize("chunk", [2, 256])
def test_viterbi_equals_all_paths(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)  # with 2, three levels of pieces
    rng = np.random.default_rng(chunk)
    rows = []
    for c in range(12):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, str(rng.choice(chat.ROLES)), rng.choice(["User: ", "Assistant: ", "", ""]) + "word " * int(rng.integers(0, 80)) + rng.choice(["?", "."])))
    seen = chat.observe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    p = chat.estimate(seen)
    got = {}
    for r in sorted(chat.recover(seen, p).collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append(r)
    for turns in got.values():
        seen = [r.mark for r in turns], [r.line for r in turns]
        best = max(path_score(p, path, *seen) for path in itertools.product(range(len(chat.ROLES)), repeat=len(turns)))
        assert np.isclose(path_score(p, [chat.ROLES.index(r.recovered) for r in turns], *seen), best)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "User: hi?", "x"), (1, 0, "user", "User: hi?", "x"), (1, 1, None, None, None), (1, None, "user", "Assistant: no place", "y"),
            (None, 3, "robot", "", "z"), (None, None, None, None, None), (2, 10**12, "assistant", "far off", "w"), (2, -5, "user", "before", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    got = chat.parse(df).collect()
    assert len(got) == 7
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 0].rendered == "<|user|>\nhi?\n<|end|>\n" and by[1, None].recovered == "assistant"
    assert chat.parse(df.limit(0)).collect() == []


def test_raw_transcripts(spark):
    text = "System: be kind\nHuman: what is it?\nBot: a stone\nHuman: thanks\nBot: welcome"
    lines = chat.segments_of(spark.createDataFrame([(1, text)], "conv_id long, text string"))
    got = [r.recovered for r in sorted(chat.parse(lines).collect(), key=lambda r: r.turn)]
    assert got == ["system", "user", "assistant", "user", "assistant"]


def test_recovered_roles(spark):
    rows = QUERIES["op7_chat"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.role == r.recovered for r in rows) / len(rows) > 0.9


COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256", "op2": "doc_id item_id", "op3": "doc_id fingerprint component_id",
    "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op5": "vec_id n_links component_id kept",
    "op6": "page_id host path rule verdict", "op7": "conv_id turn recovered rendered", "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9": "doc_id text n_replaced", "op10": "doc_id held_out score predicted",
}


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    assert df.count() > 0


def test_pipeline_equals_its_stages_by_force(spark):
    from ledgerspark.llm import toxicity
    from tests.llm.test_dedup import components_by_force, prints_by_force
    from tests.llm.test_text import base_by_force, leaks_by_force

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    scores = toxicity.score_texts(net, [t for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    group = components_by_force([prints_by_force(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in leaks_by_force(rows, items)}
    rows = [r for r in rows if r[0] not in leaked]
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {d for d, _ in rows}
    for d, t in rows:
        assert (texts[d] == t) == (not base_by_force(t))
        assert not any(x.startswith(("access", "hex")) for x in base_by_force(texts[d]))
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert json.dumps(sorted(texts)) == json.dumps(sorted({r.doc_id for r in packed}))


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
