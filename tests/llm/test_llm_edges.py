"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib

import pytest
from edge_rows import LONG, SHARED, TEXTS

from orbweave.llm import byte_bpe, decontamination, exact_dedup, language_id, near_dedup, pii, quality, sharding, substring_dedup, url_filter


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_dedup(edge, nothing):
    rows = exact_dedup.exact_dedup(edge).collect()
    assert len(rows) == len(TEXTS)
    by = {(r["doc_id"], r["text_sha256"]): r for r in rows}
    assert (by[1, sha("")]["keep_id"], by[1, sha("")]["group_size"], by[1, sha("")]["kept"]) == (2, 3, False)
    assert by[5, sha("a")]["kept"] and by[5, sha("a")]["group_size"] == 3
    assert by[13, sha(TEXTS[-2][1])]["kept"] and not by[None, sha(TEXTS[-2][1])]["kept"]
    kept = exact_dedup.kept_rows(edge)
    assert kept.columns == edge.columns
    assert sorted(map(sha, {t or "" for _, t in TEXTS})) == sorted(sha(r["text"]) for r in kept.collect())
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.kept_rows(nothing).count() == 0


def test_a_false_identifier_is_found(spark):
    store = spark.createDataFrame([(b"x", b"one"), (b"x", b"two")], "chunk_id binary, chunk binary")
    with pytest.raises(ValueError):
        exact_dedup.verify(store)


def test_language_id(edge, nothing, spark):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "the"), ("xx", None), ("yy", "123")], "lang string, text string")
    prototypes = language_id.learn(train)
    rows = language_id.predict(edge, prototypes).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "fr")) == letters and 0 <= r["score"] <= 1
        assert letters or (r["lang_pred"], r["score"]) == ("und", 0)
    assert {r["lang_pred"] for r in language_id.predict(edge, {}).collect()} == {"und"}
    assert language_id.learn(train.limit(0)) == {} and language_id.predict(nothing, prototypes).count() == 0


def test_substring_dedup(edge, nothing):
    rows = substring_dedup.substring_dedup(edge, 35).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert len(rows) == len(TEXTS)
    assert (by[1]["n_words"], by[1]["kept_sha256"]) == (0, sha(""))
    assert by[9]["n_removed"] == 60 and by[9]["kept_text"] == "before after"
    assert by[10]["n_removed"] == 60 and by[7]["n_removed"] == len(LONG.split()) and by[8]["kept_text"] == "end"
    assert by[3]["n_removed"] == by[5]["n_removed"] == 0
    assert substring_dedup.substring_dedup(nothing, 35).count() == 0


def test_quality(edge, nothing, spark):
    labels = spark.createDataFrame([(7, 1), (9, 1), (None, 1), (12, 0), (4, None)], "doc_id long, quality int")
    model = quality.learn(edge, labels)
    rows = quality.score(edge, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    empty = quality.learn(nothing, labels.limit(0))
    assert quality.score(nothing, empty).count() == 0 and len(quality.score(edge, empty).select("score").distinct().collect()) == 1


def test_sharding(edge, nothing):
    rows = sharding.shard(edge, 8).collect()
    assert len(rows) == len(TEXTS) and sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in TEXTS)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard(nothing, 8).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/71?x", "https://example.com/en/6", "x://net/de/9", "x://a.example.net/de/8", "x://b.org/es/#", "x://spam-farm.example.org/en/1", "x://xcom/en/", "x://a.com?/en/", "http://é.com/en/ü", "x://" + "a" * 5000 + ".com/en/"]
    urls += ["x://a.org/es/" + "q" * 200_000, "x://b.org/es/#"]
    method = [url_filter.Rule("block", "", "*.spam-**")]
    found = url_filter.url_filter(spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id int, url string, host string, rule string"), method=method)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and found.count() == len(urls)
    rows = {r["url"]: r for r in found.collect()}
    assert rows[urls[14]]["rule"] == "org/es/" and rows[urls[14]]["verdict"] == "block"
    assert (rows[None]["host"], rows[None]["path"], rows[None]["rule"], rows[None]["verdict"]) == ("", "", None, "allow")
    assert (rows[urls[4]]["host"], rows[urls[4]]["rule"], rows[urls[4]]["verdict"]) == ("a.example.com", "example.com/en/7", "allow")
    assert [rows[u]["rule"] for u in urls[5:14]] == ["com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, "com/en/", "com/en/"]
    assert rows[urls[9]]["verdict"] == "block" and rows[urls[10]]["verdict"] == "allow"
    assert url_filter.url_filter(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_near_dedup(edge, nothing):
    rows = near_dedup.near_dedup(edge).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by[7]["group_id"] == by[8]["group_id"] == 8 and by[7]["n_links"] == 1 and by[8]["kept"] and not by[7]["kept"]
    assert by[4]["group_id"] == 5 and by[4]["n_links"] == 2
    assert by[1]["kept"] and by[2]["kept"] and by[1]["n_links"] == 0
    assert by[9]["group_id"] == 10 and by[9]["class_id"] == 9  # 56 of 65 shingles
    kept = near_dedup.kept_rows(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 8, 10, 11, 12, 13, 14]
    assert near_dedup.near_dedup(nothing).count() == 0 and near_dedup.kept_rows(nothing).count() == 0


def test_decontamination(edge, nothing, spark):
    items = spark.createDataFrame([(1, SHARED), (2, None), (None, SHARED), (3, "too short"), (4, ""), (1, SHARED)], "item_id long, text string")
    rows = decontamination.contamination(edge, items).collect()
    assert len(rows) == len(TEXTS)
    assert {r["doc_id"] for r in rows if r["hits"]} == {9, 10}
    assert all(h["item_id"] == 1 and h["similarity"] == 1 for r in rows for h in r["hits"])
    assert {r["hits"][0]["word"] for r in rows if r["hits"]} == {0, 1}
    assert not any(r["hits"] for r in decontamination.contamination(edge, items.limit(0)).collect())
    assert decontamination.contamination(nothing, items).count() == 0


def test_byte_bpe(edge, nothing):
    rows = byte_bpe.encode(edge).collect()
    assert len(rows) == len(TEXTS) and sorted(r["doc_id"] or 0 for r in rows if not r["ids"]) == sorted(i or 0 for i, t in TEXTS if not t)
    assert byte_bpe.encode(edge.withColumn("ids", edge["key"])).collect() == byte_bpe.encode(edge).collect()
    back = byte_bpe.decode(byte_bpe.encode(edge)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t in TEXTS)
    assert byte_bpe.digests(nothing).count() == 0 and byte_bpe.encode(nothing).count() == 0


def test_pii(edge, nothing):
    rows = {r["doc_id"]: r for r in pii.find_pii(edge).collect()}
    text = TEXTS[-1][1]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in rows[14]["spans"]] == [("email", "a.b@c.de"), ("ip", "10.0.0.25")]
    assert rows[1]["spans"] == [] and rows[7]["spans"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.masked(edge).collect()}
    assert "a.b@c.de" not in clean[14] and "<email>" in clean[14] and clean[11] == TEXTS[12][1] and clean[1] is None
    assert pii.find_pii(nothing).count() == 0
