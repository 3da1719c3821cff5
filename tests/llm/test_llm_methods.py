"""Operators against plain versions of themselves, on small tables and random texts."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from orbweave.llm import byte_bpe, common, decontamination, exact_dedup, language_id, near_dedup, pii, quality, queries, sharding, substring_dedup, url_filter
from orbweave.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "pages"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    said = base.execute(queries.SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in said.fetchall())


def test_chunks_don_t_depend_on_what_stands_before():
    rng = np.random.default_rng(1)
    tail = bytes(rng.integers(32, 127, 40_000, np.uint8)).decode()
    a, b = (exact_dedup._chunks(pa.array([x + tail])) for x in ("", "something else in front "))
    a, b = set(next(a)[1]), set(next(b)[1])
    assert len(a) > 20 and len(a & b) >= len(a) - 3
    whole, parts = next(exact_dedup._chunks(pa.array([tail])))
    assert b"".join(parts) == whole and max(map(len, parts)) <= exact_dedup.MAX_CHUNK


def test_languages_are_told_apart(spark):
    rows = queries.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.99


def test_bundles_are_sums_of_bound_letters():
    own = language_id.Trigrams(["Ab1c", "", "é"])
    got = own.bundles(np.arange(3), 3)
    v = lambda c: language_id.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(float)
    gram = lambda t: np.roll(v(t[0]), 2) * np.roll(v(t[1]), 1) * v(t[2])
    assert np.array_equal(got[0], sum(gram(t) for t in (" ab", "ab ", "b c", " c ")))
    assert not got[1].any() and np.array_equal(got[2], gram(" é "))


def test_languages_are_those_of_a_plain_version(spark):
    docs = documents(spark)
    vector = lambda c: language_id.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(float)

    def bundle(text):
        plain = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        grams = Counter(plain[i : i + 3] for i in range(len(plain) - 2))
        return sum((n * np.roll(vector(g[0]), 2) * np.roll(vector(g[1]), 1) * vector(g[2]) for g, n in grams.items()), np.zeros(language_id.DIM))

    sums, bundles = {}, {d["doc_id"]: bundle(d["text"] or "") for d in docs}
    for d in docs:
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1:
            sums[d["lang"]] = sums.get(d["lang"], 0) + bundles[d["doc_id"]]
    names = sorted(sums)
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_language_id"](spark, SF).collect()}
    for d in docs:
        cosine = unit @ bundles[d["doc_id"]] / max(np.linalg.norm(bundles[d["doc_id"]]), 1e-9)
        r = rows[d["doc_id"]]
        assert r["lang_pred"] == names[int(cosine.argmax())] and r["score"] == pytest.approx(max(0, cosine.max()), abs=2e-6)


@pytest.mark.parametrize("window", [5, 12, 35])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    texts = []
    for _ in range(60):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5 and texts:
            other = rng.choice(texts).split()
            words[10:10] = other[: rng.randint(0, 80)]
        if rng.random() < 0.2:
            words += words[:50]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    seen = Counter(tuple(w[i : i + window]) for w in map(WORDS.findall, texts) for i in range(len(w) - window + 1))
    rows = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4), window, shortest=4).collect()}
    for k, text in enumerate(texts):
        w, gone = WORDS.findall(text), set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (rows[k]["n_words"], rows[k]["n_removed"]) == (len(w), len(gone))
        assert rows[k]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_levels_double():
    assert substring_dedup.levels(35) == [9, 18, 35] and substring_dedup.levels(5) == [5] and substring_dedup.levels(100) == [13, 25, 50, 100]


def test_quality_on_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()}
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(rows[t["doc_id"]]["score"], t["quality"]) for t in truth if rows[t["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())


def _moments(x):
    whole = np.append(x, np.ones((len(x), 1)), axis=1)
    return quality.Moments(whole.T @ whole)


def test_the_risk_is_that_of_the_rows():
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, (400, 3)), np.vstack([rng.normal(1, 1, (300, 3)), rng.normal(-2, 1, (100, 3))])
    mean, scale = quality._spread(_moments(u))
    sides = [_moments(x).standard(mean, scale) for x in (p, u)]
    margin = lambda x, w: (x - mean) / scale @ w[:-1] + w[-1]
    for w in rng.normal(0, 1, (20, 4)):
        good, rest = quality.risk(w, *sides, 0.75)
        assert good == pytest.approx(0.75 * ((1 - margin(p, w)) ** 2).mean() / 4)
        assert rest == pytest.approx(((1 + margin(u, w)) ** 2).mean() / 4 - 0.75 * ((1 + margin(p, w)) ** 2).mean() / 4)
    w = quality.minimise(*sides, 0.75, 0.02)
    assert quality.risk(w, *sides, 0.75)[1] > -0.01
    own = lambda w: quality.risk(w, *sides, 0.75)[0] + max(0, quality.risk(w, *sides, 0.75)[1]) + 0.02 * (w[:-1] ** 2).sum()
    assert all(own(w) <= own(w + d) + 1e-3 for d in rng.normal(0, 0.2, (200, 4)))
    model = quality.fit(_moments(np.repeat(p, 25, 0)), _moments(np.repeat(u, 25, 0)), 0.75)
    assert model.score(p).mean() > 0.8 and model.score(u[300:]).mean() < 0.3 and (model.score(u[300:])[None] < model.score(p)[:, None]).mean() > 0.99


def test_the_prior_is_estimated_without_a_negative():
    rng = np.random.default_rng(6)
    bins = lambda x: np.bincount(np.clip((x + 6) * 20, 0, 239).astype(int), minlength=240)
    for prior in (0.2, 0.5, 0.9):
        n = int(40_000 * prior)
        found = quality.mixture(bins(rng.normal(2, 1, 4000)), bins(np.append(rng.normal(2, 1, n), rng.normal(-2, 1, 40_000 - n))))
        assert abs(found - prior) < 0.06
    assert quality.mixture(np.zeros(5, int), np.ones(5, int)) == 0.5


def test_quality_reads_no_label_0(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one, other = quality.learn(docs, labels), quality.learn(docs.repartition(7), labels.filter("quality = 1"))
    assert np.array_equal(one.weights, other.weights) and one.prior == other.prior and 0.05 < one.prior < 0.98
    rows = docs.select("text").toArrow().column("text")
    x = np.vstack([quality.features(c) for c in rows.chunks])
    whole = np.append(x.astype(float), np.ones((len(x), 1)), axis=1)
    assert np.allclose(quality.moments(docs).products, whole.T @ whole / len(x))


def plain_pack(items, residual, total):
    residual, out = [list(r) for r in residual], [0] * len(items)
    parts = [[x / max(t, 1) for x, t in zip(item, total, strict=True)] for item in items]
    for i in sorted(range(len(items)), key=lambda i: -max(parts[i])):
        gain = [sum(a * b for a, b in zip(r, parts[i], strict=True)) for r in residual]
        out[i] = k = gain.index(max(gain))
        residual[k] = [a - b for a, b in zip(residual[k], parts[i], strict=True)]
    return out


def test_packing_is_that_of_a_plain_version():
    rng = np.random.default_rng(2)
    items = np.rint(np.exp(rng.normal(6, 1.2, (20_000, 3)))) + 1  # all differ, so that no sums tie
    total = items.sum(axis=0)
    got = sharding.pack(items, np.full((8, 3), 1 / 8), total)
    want = np.array(plain_pack(items.tolist(), [[1 / 8] * 3] * 8, total.tolist()))
    assert (got == want).mean() > 0.999  # rounding may turn a tie
    filled = np.array([items[got == k].sum(axis=0) for k in range(8)])
    assert np.abs(filled / total * 8 - 1).max() < 0.001


def test_every_group_is_placed_and_shards_are_even(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BATCH", 5000)
    docs = spark.range(60_000).selectExpr("id AS doc_id", "repeat(concat('w', CAST(id % 50000 AS STRING), ' '), 1 + CAST(pow(2.0, pmod(hash(id % 50000), 700) / 100.0) AS INT)) AS text", "id AS size", "'x' AS shard", "id AS rows")
    rows = sharding.shard(docs, 8).toPandas()
    per = rows.groupby("shard").agg(size=("size", "sum"), tokens=("tokens", "sum"), rows=("size", "count"))
    assert len(per) == 8 and ((per / per.mean() - 1).abs().max() < 0.01).all()
    assert rows.assign(text=rows.doc_id % 50_000).groupby("text")["shard"].nunique().max() == 1 and (rows.pieces == 1).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])


def test_packing_is_even(spark):
    rows = queries.QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(abs(v - mean) for v in size.values()) < 0.02 * mean
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len({(texts[r["doc_id"]], r["shard"]) for r in rows}) == len(set(texts.values()))
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_only_a_group_of_more_bytes_than_a_shard_is_cut(spark):
    rows = sharding.shard(spark.range(800).selectExpr("id AS doc_id", "IF(id < 400, 'same text', 'text ' || id) AS text"), 8).collect()
    count = Counter(r["shard"] for r in rows)
    assert max(count.values()) < 130 and {r["pieces"] for r in rows if r["doc_id"] < 400} == {5} and {r["pieces"] for r in rows if r["doc_id"] >= 400} == {1}
    rows = sharding.shard(spark.range(800).selectExpr("id AS doc_id", "IF(id < 400, 'a', repeat('text ' || id, 20)) AS text"), 8).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] < 400}) == 1 and {r["pieces"] for r in rows} == {1}


def test_automaton(spark):
    rng = random.Random(9)
    to_regex = lambda g: "".join(".*" if t == "**" else "[^/]*" if t == "*" else re.escape(t) for t in re.findall(r"\*\*|.", g))
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "."]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["".join(rng.choice("ab/.é") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = url_filter.Automaton(globs).fits(texts)
    assert url_filter.Automaton(globs).words > 1
    for k, g in enumerate(globs):
        want = re.compile(to_regex(g), re.S)
        assert [bool(want.fullmatch(t)) for t in texts] == got[:, k].tolist(), g


def test_five_thousand_globs(spark):
    rng = random.Random(12)
    to_regex = lambda g: "".join(".*" if t == "**" else "[^/]*" if t == "*" else re.escape(t) for t in re.findall(r"\*\*|.", g))
    part = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    names = sorted({f"{part()}.{part()}/{part()}" for _ in range(9000)})[:4000]
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), n) for n in names]
    method = [url_filter.Rule("block", "", f"**.{part()}/{part()}*{part()}**") for _ in range(1000)]
    urls = [f"x://{part()}.{part()}.{part()}/{part()}{part()}" for _ in range(300)] + ["x://a.b/" + "abc" * 30_000, "x://" + "b" * 50_000 + ".a/c"]
    rows = url_filter.url_filter(spark.createDataFrame([(k, u, "h" * 50) for k, u in enumerate(urls)], "page_id int, url string, html string"), rules, method).collect()
    ranked = sorted(rules, key=lambda r: -len(r.name))
    compiled = [re.compile(to_regex(r.pattern()), re.S) for r in ranked]
    blocked = [re.compile(to_regex(r.glob), re.S) for r in method]
    assert len(rows) == len(urls) and len(url_filter.automaton(tuple(r.pattern() for r in [*ranked, *method])).start) > 500
    for r in rows:
        text = f".{r['host']}{r['path']}"
        if len(text) > 1000:  # regular expressions take too long over these
            own = [x for x in ranked if ("." + r["host"]).endswith("." + x.name.partition("/")[0]) and r["path"].startswith("/" + x.name.partition("/")[2])]
            assert r["rule"] == (own[0].name if own else None)
            continue
        hit = next((x for x, c in zip(ranked, compiled, strict=True) if c.fullmatch(text)), None)
        assert r["rule"] == (hit.name if hit else None)
        assert r["verdict"] == (hit.verdict if hit else "block" if any(c.fullmatch(text) for c in blocked) else "allow")
    assert sum(r["rule"] is not None for r in rows) > 20 and len({r["verdict"] for r in rows if not r["rule"]}) == 2


def test_rules_from_a_file(tmp_path):
    path = tmp_path / "rules"
    path.write_text("# rules\nblock com/en/\n\nallow *.b/**x # a glob\n")
    assert [(r.verdict, r.pattern()) for r in url_filter.read_rules(str(path))] == [("block", "*.com/en/**"), ("allow", "*.b/**x")]
    path.write_text("drop x")
    with pytest.raises(ValueError):
        url_filter.read_rules(str(path))


def test_prefix_reaches_the_recall():
    k = near_dedup.prefix(0.8)
    assert 1 - (1 - 0.8**k) ** near_dedup.TREES >= near_dedup.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** near_dedup.TREES


def test_near_dedup(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(120):  # one large group whose members differ in many ways
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], "", " ".join(f"q{k}" for k in range(40)), "one two", "one  two"]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.split()) else frozenset() for t in texts]
    near = lambda a, b: bool(a | b) and len(a & b) / len(a | b) >= 0.8
    want = [sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    rows = {r["doc_id"]: r for r in near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)).collect()}
    assert [rows[i]["n_links"] for i in range(len(texts))] == want
    group = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [max([group[i], *(group[j] for j, b in enumerate(sets) if near(a, b))]) for i, a in enumerate(sets)]
        if new == group:
            break
        group = new
    assert [rows[i]["group_id"] for i in range(len(texts))] == group


def test_blocks_of_a_component_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    test_near_dedup(spark)


def thue_morse(n, a="a", b="b"):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


ONE, OTHER = thue_morse(1024), thue_morse(1024, "b", "a")  # words that polynomials modulo 2^64 do not tell apart


def test_words_made_to_collide(spark):
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{ONE} {rest}"), (2, f"{OTHER} {rest}"), (3, f"{ONE} a b c"), (4, f"{OTHER} a b c"), (5, f"{ONE} p q r s t u"), (6, f"{OTHER} v w x y z a")], "doc_id int, text string")
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(docs, 35).collect()} == {0}
    rows = {r["doc_id"]: r for r in near_dedup.near_dedup(docs).collect()}
    assert [rows[k]["n_links"] for k in sorted(rows)] == [1, 1, 0, 0, 0, 0]  # the first two share 30 of 32 shingles
    assert all(rows[k]["class_id"] == k for k in rows)
    items = spark.createDataFrame([(1, f"{ONE} one two three four"), (2, ONE)], "item_id int, text string")
    seen = spark.createDataFrame([(1, f"{OTHER} one two three four"), (2, OTHER), (3, f"x {ONE}")], "doc_id int, text string")
    assert {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontamination.contamination(seen, items).collect()} == {1: [], 2: [], 3: [2]}


def test_words_decide_where_all_hashes_are_equal(monkeypatch):
    flat = lambda data, starts, ends, seed=1: np.zeros(len(starts), np.uint64)
    for module in (common, substring_dedup):
        monkeypatch.setattr(module, "span_hashes", flat)
    texts = pa.array(["a b c d e f", "a b c d e g", "a b  c d e f", "x", "x y", "x"])
    values, first = near_dedup.shingles(substring_dedup.Words(texts, 5), 5, exact=True)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert sets[0] == sets[2] and sets[3] == sets[5] and len(set(sets)) == 4 and len(sets[0] & sets[1]) == 1 and not sets[3] & sets[4]
    words = substring_dedup.Words(texts, 3)
    ids = list(zip(*words.digests(3, np.flatnonzero(words.whole)), strict=True))
    assert len(ids) == 12 and len(set(ids)) == 5
    shelf = decontamination.Shelf(5)
    shelf.add("item", decontamination._lower(pa.array(["a b c d e f"])))
    shelf.close()
    docs = decontamination._lower(pa.array(["q a B c d e f q", "f e d c b a", "a b c d e"]))
    assert dict(decontamination._found(docs, shelf, shelf.look(), 0.8)) == {0: {0: (1.0, 1)}}


def test_rows_that_are_counted_grow_with_the_corpus(spark):
    def counted(n):
        h = np.random.default_rng(n).integers(0, 2**63, n)
        rows = []
        for src in range(0, n // 1000):
            (kept, _c, twice), _ = substring_dedup._sent(h[src * 1000 : src * 1000 + 1000].astype(np.uint64), None)
            rows.append((src, kept, b"", twice))
        return substring_dedup._rows(spark.createDataFrame(rows, "src long, h binary, c binary, twice binary"), False).count()

    assert counted(20_000) == 20_000 and counted(60_000) == 60_000


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_repeated(spark, size):
    rng = random.Random(size)
    rows = [(rng.randrange(400), rng.randrange(3), rng.randrange(9), k) for k in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        told = substring_dedup.repeated(spark.createDataFrame(rows, "h long, c long, src long, i int"), ["h", "c"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = Counter((h, c) for h, c, _, _ in rows)
    assert sorted((r["src"], int(i)) for r in told for at in r["told"] for i in np.frombuffer(at, np.int32)) == sorted((s, i) for h, c, s, i in rows if n[h, c] > 1)


def test_ids_and_texts_that_look_alike_have_keys_of_their_own(spark):
    rows = [(None, "x"), ("null", "x"), ("n", "x"), ("v1:a", "x"), ("a", "bx"), ("ab", "x"), ("a", ":x"), ("a:", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert df.select(common.row_key("doc_id", "text").alias("k")).distinct().count() == len(rows)


def test_recall_near_the_threshold(spark):
    rng = random.Random(21)
    docs, pairs = [], 1500
    for k in range(pairs):
        w = [f"p{k}x{i}" for i in range(140)]
        other = list(w)
        for at in rng.sample(range(4, 136, rng.choice([1, 2, 5])), 3):  # 15 of 136 shingles go at most: similarity 0.80 and more
            other[at] = "new"
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in docs)]
    near = {k for k in range(pairs) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1]) - 1e-6}
    rows = {r["doc_id"]: r["n_links"] for r in near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id int, text string").repartition(4)).collect()}
    found = {k for k in range(pairs) if rows[2 * k]}
    assert len(near) > 500 and found <= near and len(found) >= 0.999 * len(near)


def test_a_subtrie_is_searched_from_its_leaves():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 60_000, 192).astype(np.uint16)
    equal = np.repeat(base[None, :], 6, axis=0)
    assert near_dedup.join_subtrie(equal[:, :8], equal, 0.67, 5)[1] == 8  # one component at whole labels: the prefix stays
    mixed = equal.copy()
    mixed[3:, 6] += 1  # shares only six minhashes of this label
    edges, depth = near_dedup.join_subtrie(mixed[:, :8], mixed, 0.67, 5)
    assert depth == 6 and len(edges) == 5
    far = equal.copy()
    far[3:, 8:] += 1
    assert near_dedup.join_subtrie(far[:, :8], far, 0.67, 5) [1] == 5


def test_crowded_subtries_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 7)
    test_near_dedup(spark)


def test_links_of_many_short_sets_are_sparse():
    rng = np.random.default_rng(8)
    n = 60_000
    sets = np.sort(rng.integers(0, 30_000, (n, 5)), axis=1)
    sets[1::100] = sets[::100]
    values, first = sets.ravel(), np.arange(n + 1) * 5
    some = near_dedup.Sets(values, first)
    tracemalloc.start()
    found = [(a, b) for x, y in near_dedup.links(some, 0.8, np.arange(n), np.arange(n)) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert {(k, k + 1) for k in range(0, n, 100)} <= set(found) and len(found) < 1000


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_links_are_those_of_all_pairs(threshold):
    rng = np.random.default_rng(9)
    own = [np.unique(rng.integers(0, 14, rng.integers(1, 12))) for _ in range(700)]
    some = near_dedup.Sets(np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own])))
    for left, right in ((np.arange(700), np.arange(700)), (np.arange(300), np.arange(300, 700))):
        found = sorted((a, b) for x, y in near_dedup.links(some, threshold, left, right) for a, b in zip(x.tolist(), y.tolist(), strict=True))
        near = lambda a, b: len(np.intersect1d(own[a], own[b])) >= threshold * len(np.union1d(own[a], own[b])) - 1e-6
        assert found == [(a, b) for a in left.tolist() for b in right.tolist() if (a < b or len(left) != len(right)) and near(a, b)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["ab", "cd", "efg", "hi", "jkl"]) + str(rng.randrange(60))
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 90)))) for k in range(40)]
    docs = []
    for k in range(80):
        w = [word() for _ in range(rng.randint(0, 150))]
        if k % 2:
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                part[rng.choice([0, 1, -1, -2, rng.randrange(len(part))])] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((k, " ".join(w).upper() if k % 3 == 0 else " ".join(w)))

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    weight = lambda g: sum(len(x) for x in g)
    want = {}
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            q = item.split()
            for s in range(len(w) - len(q) + 1):
                a, b = bag(w[s : s + len(q)]), bag(q)
                both = sum(weight(g) * n for g, n in (a & b).items())
                value = both / sum(weight(g) * n for g, n in (a | b).items())
                if value >= 0.8 - 1e-9:
                    want[d, i] = max(want.get((d, i), 0), round(value, 6))
    rows = decontamination.contamination(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string")).collect()
    got = {(r["doc_id"], h["item_id"]): h["similarity"] for r in rows for h in r["hits"]}
    assert len(want) > 15 and 1.0 > min(want.values()) and got == pytest.approx(want)


def test_a_text_shorter_than_the_item_is_one_window(spark):
    rng = random.Random(11)
    items = [(k, [f"{rng.choice(['ab', 'cde', 'f'])}{rng.randrange(400)}" for _ in range(n)]) for k, n in enumerate((9, 15, 38, 59, 90))]
    docs = [(0, items[2][1][:-1]), (1, items[2][1][1:]), (2, items[2][1][:5]), (3, items[2][1][:4])]  # 37 of 38 words, twice; 5 and 4 of 38
    for k in range(4, 124):
        w = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 12)):
            if len(w) > 1:
                w.pop(rng.choice([0, -1, rng.randrange(len(w))]))
        docs.append((k, w))

    def bag(w):
        return Counter({g: n * sum(map(len, g)) for g, n in Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)).items()})

    want = {}
    for d, w in docs:
        for i, q in items:
            size = min(len(w), len(q))
            value = max(sum((bag(w[s : s + size]) & bag(q)).values()) / sum((bag(w[s : s + size]) | bag(q)).values()) for s in range(len(w) - size + 1))
            if value >= 0.8 - 1e-9:
                want[d, i] = round(value, 6)
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} int, text string") for name, rows in (("doc_id", docs), ("item_id", items))]
    rows = decontamination.contamination(*frames).collect()
    got = {(r["doc_id"], h["item_id"]): h["similarity"] for r in rows for h in r["hits"]}
    assert got == pytest.approx(want) and {(0, 2), (1, 2)} <= set(want) and not {(2, 2), (3, 2)} & set(want)
    assert all(h["word"] == 0 for r in rows for h in r["hits"]) and sum(len(dict(docs)[d]) < len(items[i][1]) for d, i in want) > 15


def test_items_of_one_to_four_words_are_found_word_for_word(spark):
    rng = random.Random(13)
    items = [(1, "a"), (2, "B c"), (3, "a b c"), (4, "c c a b"), (5, ""), (6, "a b c d e"), (7, "zz"), (8, "c c")]
    docs = [(k, rng.choice([" ", "\n "]).join(rng.choice("abcABCd") for _ in range(rng.randint(0, 9)))) for k in range(60)] + [(60, "x b"), (61, "c y"), (62, "ab bc")]
    want = {}
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            q = item.lower().split()
            at = [s for s in range(len(w) - len(q) + 1) if w[s : s + len(q)] == q] if 0 < len(q) < 5 else []
            if at:
                want[d, i] = (1.0, at[0])
    rows = decontamination.contamination(spark.createDataFrame(docs, "doc_id int, text string").repartition(2), spark.createDataFrame(items, "item_id int, text string")).collect()
    got = {(r["doc_id"], h["item_id"]): (h["similarity"], h["word"]) for r in rows for h in r["hits"] if h["item_id"] != 6}
    assert got == want and {i for _, i in want} == {1, 2, 3, 4, 8}
    assert all([h["item_id"] for h in r["hits"]] == sorted(h["item_id"] for h in r["hits"]) for r in rows)


def test_several_indexes_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "INDEX_WORDS", 100)
    test_decontamination(spark)


def test_a_plan_holds_one_index(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "INDEX_WORDS", 10)
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(1 + k % 9))) for k in range(40)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "w3x0 w3x1 w3x2 w3x3 w8x0"), (2, " ".join(f"w26x{i}" for i in range(9)))], "doc_id int, text string")
    for kind in ("smallint", "decimal(9,2)", "date", "string"):
        ids = "date_add(DATE'2020-01-01', item_id)" if kind == "date" else "item_id"
        own = items.selectExpr(f"CAST({ids} AS {kind}) AS item_id", "text")
        found = decontamination.contamination(docs, own)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        rows = {r["doc_id"]: r["hits"] for r in found.collect()}
        assert {k: len(v) for k, v in rows.items()} == {1: 1, 2: 1} and found.schema["hits"].dataType.elementType["item_id"].dataType == own.schema["item_id"].dataType


def test_bpe_is_that_of_the_library():
    import public_tokenizers as P
    import tiktoken

    tokens = tuple(byte_bpe.read_ranks(byte_bpe.default_ranks()))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "'d", " '", "é", "ß", "1", "23", "!", "!!", "=", "\u00a0", "\u3000", "日本", "😀", "Th", "the", "x" * 70, "aaaa", "'S", "\r\n", "क्षि", "ab" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", "a" * 20_000, "=" * 20_001, " " * 3000, "'" * 999, "x'", "'r", "a'resx"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    for out, back in byte_bpe.decode_batches(byte_bpe.encode_batches(iter([batch]), tokens), tokens):
        for k, ids, text in zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist(), back, strict=True):
            assert ids == library.encode_ordinary(texts[k]) and text == texts[k].encode()


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(common, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words, numbers, places = byte_bpe.words_of(np.frombuffer(b"one two one", np.uint8), np.array([0, 11]))
    assert [words[k] for k in numbers] == [b"one", b" two", b" one"] and places.tolist() == [3]


def test_bpe_query_is_that_of_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    tokens = byte_bpe.read_ranks(byte_bpe.default_ranks())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_byte_bpe"](spark, SF).collect()}
    for d in documents(spark):
        ids = library.encode_ordinary(d["text"] or "")
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_ranks_without_a_gap(tmp_path):
    path = tmp_path / "r"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (b + (b > 9)) for b in range(256)))
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_spans(spark):
    rng = random.Random(2)
    parts = ["1", "23", "255", "256", ".", "..", "@", "a", "b.c", "-", " ", "+", "+1 ", "(", "4111111111111111", "4111 1111 1111 1111", "é", "x@y.zz", "://", "token = "]
    machine = pii.anchors()
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(20_000)] + [r["text"] for r in documents(spark)]
    for t in texts:
        assert [s for s in pii.find(t, machine) if s[2] in pii.BASE] == plain_pii(t), t


def test_pii_query(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_pii"](spark, SF).collect()}
    for d in documents(spark):
        own = plain_pii(d["text"])
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in own).encode()).hexdigest()
        r = rows[d["doc_id"]]
        assert r["base_sha256"] == digest and [r[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in own) for k in pii.BASE]


def test_method_spans():
    machine = pii.anchors()
    found = lambda t: [(k, t[a:b]) for a, b, k in pii.find(t, machine)]
    assert found('token = "ab12cd34" x') == [("account", "ab12cd34")]
    assert found("see https://user:pw@host.example/x") == [("url", "https://user:pw@host.example"), ("email", "pw@host.example")]
    assert found("IBAN: DE89370400440532013000")[0] == ("account", "DE89370400440532013000")
    assert found("tokens of love, account of the sea, password") == []


def test_pipeline_against_a_plain_version(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    rows = [r for r in documents(spark) if any(c.isalpha() for c in r["text"] or "")]
    last = {}
    for r in rows:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    rows = [r for r in rows if last[r["text"]] == r["doc_id"]]
    sets = {r["doc_id"]: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in rows if (w := WORDS.findall(r["text"]))}
    group = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = max(group[a], group[b])
    rows = [r for r in rows if group.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]
    items = [x["text"].lower().split() for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def seen(text):
        w = text.lower().split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for q in items:
            b = [tuple(q[i : i + 5]) for i in range(len(q) - 4)]
            if len(own & set(b)) >= 0.8 * len(b):
                return True
        return False

    want = {r["doc_id"]: r["text"] for r in rows if not seen(r["text"])}
    assert {r["doc_id"] for r in got} == set(want)
    assert all(r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in got)


def test_pipeline_on_edges(spark, edge, store):
    items = spark.createDataFrame([(1, "nothing of the kind is found in any of these texts")], "item_id long, text string")
    folder = store(documents=edge, benchmark=items)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [5, 8, 10, 11, 13, 14]
    assert corpus_pipeline.run(spark, store(documents=edge.limit(0))).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, folder).columns == edge.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_labelled_texts_without_a_letter_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "12 3", "en"), (2, "plain words", None), (3, None, None), (4, "!?", "fr"), (5, "é", None)], "doc_id int, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identified(spark, docs, SF).collect()) == [2, 5]
