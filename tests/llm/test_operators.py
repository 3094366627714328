"""Every corpus operator against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelveil.llm import chat, decontaminate, fingerprint, jaccard, language, licenses, oracles, quality, queries, sharding, warc
from pixelveil.llm.bpe import WordBpe, bpe, build
from pixelveil.llm.common import alnum_words, space_words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = words(80, 1)
    near = base.split()
    near[40] = "changed"
    rows = [base, base, " ".join(near), "", None, "one two", "one two", "the MIT License, and gnu general public license", words(6000, 3), "\x00\n\t", "É ünï 🙂 cc by cc by"]
    rows += [words(60, 9 + i) for i in range(8)]
    rows += [" ".join(base.split()[:70] + words(10, 50 + i).split()) for i in range(6)]
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    odd = [(None, "a text without an id", None, None, None), (3, "", "en", "src0", 0)]
    return spark.createDataFrame(corpus + odd, DOCS).withColumn("n_words", F.lit("clash")).withColumn("score", F.lit("clash")).repartition(3)


def test_wu_manber_finds_what_a_scan_finds():
    r = random.Random(4)
    text = [bytes([97 + r.randrange(3)]) for _ in range(500)]
    for m in (1, 2, 3, 5):
        patterns = {b" ".join(text[i : i + m]): i for i in (3, 90, 200)} | {b" ".join([b"z"] * m): -1}
        got = {(s, v) for s, v in decontaminate.WuManber(m, patterns).find(text)}
        assert got == {(i, patterns[k]) for i in range(len(text) - m + 1) if (k := b" ".join(text[i : i + m])) in patterns}


@pytest.mark.parametrize("block", [10, 100_000])
def test_decontaminate(spark, corpus, docs, block):
    items = [("b", " ".join(corpus[0][1].split()[5:30])), ("a", "one two"), ("n", None), ("e", ""), (None, "cc by"), ("a", "one two")]
    out = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"), block_windows=block)
    got = {r.doc_id: r for r in out.where("doc_id is not null and not (doc_id = 3 and n_words > 0)").collect()}
    windows = [(i, w.split(b" ")) for i, t in items for w in decontaminate.item_windows(t)]
    for i, t, *_ in corpus:
        w, hit, found = alnum_words(t), set(), set()
        for item, p in windows:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found |= {item} - {None}
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(found), bool(hit))
        assert sum(s.end - s.start for s in r.hit_spans) == len(hit)
    assert out.count() == len(corpus) + 2


def test_bpe_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    out = bpe(docs, path)
    for r in out.collect():
        want = tk.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids_le, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == tk.decode(want, skip_special_tokens=False)
    model, rng = WordBpe(build(path)), random.Random(2)
    odd = ["a" * 3000, "ΑΣ ΟΔΟΣ", "x\x1cy", "it's 'LL", "<|endoftext|>a<|startoftext|>", "é Ⱥ İ ß ½², 한국"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), 0x1F600 + rng.randrange(60)])) for _ in range(30)) for _ in range(300)]
    odd += ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 200))) for _ in range(500)]
    for t, ids in zip(odd, model.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t


def components(rows):
    """By comparing all pairs of exact shingle sets."""
    sets = {}
    for i, t in rows:
        w = space_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [2, 256])
def test_jaccard(spark, corpus, docs, block):
    rng = random.Random(8)
    base = words(60, 77).split()
    more = []
    for i in range(40):  # a chain of near copies, some beyond the threshold of others
        base = base[:]
        base[rng.randrange(60)] = f"x{i}"
        more.append((100 + i, " ".join(base), None, None, None))
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, DOCS).select("doc_id", "text"))
    got = jaccard.jaccard_components(every, block=block, open_block=block).collect()
    want = components([(i, t) for i, t, *_ in corpus + more])
    assert len(got) == len(want) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_jaccard_with_wide_tokens(spark, monkeypatch):
    """Texts with one opening, some linked: the joins by token deal it over parts, and links are those of all pairs."""
    opening = words(60, 5)
    rows = [(i, f"{opening} " + " ".join(f"own{i}x{k}" for k in range(10 + i % 7))) for i in range(120)]
    rows += [(200 + i, " ".join(w for k, w in enumerate(t.split()) if k != 65)) for i, t in rows[:20]]
    dealt, meet = [], jaccard._meet
    monkeypatch.setattr(jaccard, "_meet", lambda left, right, wide, by=None: (dealt.append(wide.agg(F.max("lefts")).first()[0]), meet(left, right, wide, by))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), spread=8).collect()}
    assert got == components(rows)
    assert len(dealt) == jaccard.TURNS + 1 and min(dealt) > 4


@pytest.mark.parametrize("by", [None, "group"])
def test_wide_tokens_are_dealt_on_both_sides(spark, by):
    """The join gives each pair once, and no key of it holds many more rows of a side than a part has."""
    left = spark.range(900).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id")).cast("bigint").alias("token"), F.col("id").alias("sid"))
    groups = spark.range(300).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") + 500).cast("bigint").alias("token"), F.col("id").alias("group"))
    right = groups if by else groups.select("token").distinct()
    wide = jaccard._wide(left, 100).withColumn("rights", F.lit(4))
    assert [tuple(r) for r in wide.collect()] == [(7, 6, 4)]
    got = jaccard._meet(left, right, wide, by)
    assert sorted(got.collect()) == sorted(left.join(right, "token").collect())
    assert jaccard._wide(left, 600) is None and jaccard._meet(left, right, None, by).count() == got.count()
    keys = ["l", "r"] if by else ["l"]
    parts = jaccard._dealt(left, wide, "sid", "lefts", "l", ("rights", "r") if by else None).where("token = 7").groupBy(keys).count()
    assert parts.count() == (24 if by else 6) and parts.agg(F.max("count")).first()[0] < 150
    if by:
        parts = jaccard._dealt(right, wide, by, "rights", "r", ("lefts", "l")).where("token = 7").groupBy("l", "r").count()
        assert parts.count() == 24 and parts.agg(F.max("count")).first()[0] < 80


@pytest.mark.parametrize("most", [10, 300, 5000])
def test_frequent_tokens_fill_their_bound(spark, monkeypatch, most):
    """A step of the histogram that doesn't fit as a whole gives a share; rarer steps give nothing."""
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", most)
    rows = [(t, 64) for t in range(1000)] + [(t, 200) for t in range(1000, 1050)] + [(t, 2) for t in range(2000, 2300)]
    got = jaccard._frequent(spark.createDataFrame(rows, "sid bigint, seen bigint")).tolist()
    times = [dict(rows)[t] for t in got]
    assert times == sorted(times) and len(set(got)) == len(got) and len(got) <= 1.2 * most + 10
    if most == 10:
        assert 0 < len(got) and set(times) == {200}
    elif most == 300:
        assert times.count(200) == 50 and 150 < times.count(64) < 350 and 2 not in times
    else:
        assert len(got) == len(rows)


def test_language_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = queries.op4_language(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out)
    assert np.mean([rows[r.doc_id].lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(docs):
    got = {r.text: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert got[None].lang_pred == got[""].lang_pred == got["\x00\n\t"].lang_pred == "und"
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def test_licenses(docs):
    for r in licenses.scan(docs).collect():
        w = [x.decode() for x in alnum_words(r.text)]
        places = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
        for d in r.detections:
            assert " ".join(w[d.start : d.end])
            assert not any(o.start <= d.start and o.end >= d.end and o.priority > d.priority for o in r.detections)


def test_licenses_suppression(spark):
    t = "Released under the MIT License. Licensed under the GNU Lesser General Public License version 2 1 or later."
    r = licenses.scan(spark.createDataFrame([(1, t)], "doc_id int, text string")).first()
    w = [x.decode() for x in alnum_words(t)]
    assert r.labels == "lgpl,mit" and r.base_labels == "mit"
    assert {" ".join(w[d.start : d.end]) for d in r.detections if d.label == "mit"} == {"released under the mit license"}


def test_sharding(docs):
    rows = sharding.shard(docs, 4).collect()
    assert sorted(r.row_number for r in rows) == sorted(r.position for r in rows) == list(range(len(rows)))
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard(docs.repartition(7), 4).collect()
    assert sorted((r.size, r.text_crc32, r.shard, r.slot) for r in rows) == sorted((r.size, r.text_crc32, r.shard, r.slot) for r in again)
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null and not (doc_id = 3 and text = '')").collect()}
    for r in rows:
        if r.doc_id in texts:
            b = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(b) + 16, zlib.crc32(b))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<%|im_end|>", "<%%|", "<", "|im_end|>", "", None, "a\n<|im_end|>\n", "<<|", "plain"]
    rows = [(i % 4, i, role, t) for i, t in enumerate(odd * 3) for role in ("user", "assistant", "odd<|role\n<%n|", None)] + [(None, None, "user", "x"), (9, 0, "assistant", "only")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)).collect()
    assert len(out) == 6
    for r in out:
        mine = sorted(((t is not None, t or 0), (a or "", b or "")) for c, t, a, b in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.parsed] == [x for _, x in mine]
        assert "".join(r.loss_texts) == "".join(b for _, (a, b) in mine if a == "assistant")


def test_fingerprints(spark, corpus):
    table = spark.createDataFrame(corpus, DOCS)
    got = {r.doc_id: r for r in fingerprint.with_next(table.repartition(3), "doc_id bigint, text string, after string", lambda: lambda *x: x).collect()}
    for (i, t, *_), (_, n, *_) in zip(corpus, corpus[1:] + corpus[:1], strict=True):
        assert (got[i].text, got[i].after) == (t or "", n or "")
    again = {r.doc_id: r.after for r in fingerprint.with_next(table, "doc_id bigint, text string, after string", lambda: lambda *x: x, bucket_chars=500).collect()}
    assert again == {i: r.after for i, r in got.items()}
    a, b = words(3000, 1, 10**6), words(3000, 2, 10**6)
    both = fingerprint.sketch(f"{a} {b}")
    assert np.array_equal(fingerprint.decode(fingerprint.encode(both)), both)
    assert abs(fingerprint.distinct(both) / 5996 - 1) < 0.3
    assert abs(fingerprint.resemblance(fingerprint.sketch(a), both) - 0.5) < 0.15
    assert fingerprint.containment(fingerprint.sketch(a), both) > 0.8
    assert fingerprint.resemblance(fingerprint.sketch(""), fingerprint.sketch(None)) == 1.0


def test_fingerprint_query(spark):
    out = {r.doc_id: r for r in queries.op8_fingerprint(spark, SF).collect()}
    d = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for (i, t), (_, n) in zip(d, d[1:] + d[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert out[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and out[i].n_chars == len(t)
        assert out[i].edited_fingerprint == fingerprint.encode(fingerprint.sketch(e))


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = [r for r in queries.op9_quality(spark, "/root/testdata/sf0.1").where("held_out").collect() if labels.get(r.doc_id) is not None]
    good = [r.predicted for r in out if labels[r.doc_id] == 1]
    bad = [r.predicted for r in out if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (5, None)], "doc_id bigint, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(r.score == 1.0 for r in out)
    assert np.isfinite([quality.statistics(t) for t in (None, "", "\n\n", "A" * 100_000, "🙂")]).all()


def test_warc(spark):
    long = "x" * 50 + "ü" * 40
    rows = [(5, "u", long), (3, None, long), (3, "b", long), (4, "v\r\nX: y", "short"), (9, "w", "short"), (None, "z", long), (7, "q", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archives = warc.write(warc.plan(pages), archive_bytes=900)
    got = warc.read_back(archives).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got)
    assert kinds == sorted([(5, "revisit", 3, 130), (3, "response", 0, 130), (3, "revisit", 3, 130), (4, "response", 0, 5), (9, "response", 0, 5), (0, "response", 0, 130), (7, "response", 0, 0)])
    for r in got:
        if r.payload is not None:
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest


@pytest.mark.parametrize("most", [0, 200_000])
def test_warc_record_ids_are_unique_and_references_resolve(spark, most):
    a, b = "a" * 150, "b" * 150
    rows = [(3, "u", a), (3, "v", b), (None, "w", a), (None, "x", b), (None, "x", "short"), (None, "y", "short"), (3, "u", "short"), (3, "u", a), (8, "z", b), (8, "z", b), (8, "q", None), (8, "q", "")]
    archives = warc.write(warc.plan(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), most_broadcast=most))
    heads = [h for r in archives.collect() for h, _ in warc.read(bytes(r.content))]
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    assert len(heads) == len(rows) == len(by_id)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            to = by_id[h["WARC-Refers-To"]]
            assert (to["WARC-Type"], to["WARC-Payload-Digest"], to["X-Page-ID"]) == ("response", h["WARC-Payload-Digest"], h["X-Refers-To-Page-ID"])
    assert sorted((h["X-Page-ID"], h["WARC-Type"]) for h in heads if h["WARC-Payload-Digest"][7:] == hashlib.sha256(b.encode()).hexdigest()) == [("", "response"), ("3", "response"), ("8", "revisit"), ("8", "revisit")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_components(docs).count() == 0
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert sharding.shard(docs).count() == 0 and licenses.scan(docs).count() == 0
    assert language.identify(docs, language.fit(docs)).count() == 0
    assert quality.classify(docs, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
    assert fingerprint.with_next(docs, "doc_id bigint", lambda: lambda i, t, n: [i]).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    assert warc.read_back(warc.write(warc.plan(spark.createDataFrame([], "page_id bigint, url string, html string")))).count() == 0


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = db.execute(oracles.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(map(repr, r.fetchall())) == sorted(repr(tuple(x)) for x in queries.queries()[name](spark, SF).select(cols).collect())


def plain_discriminant(rows, labels):
    """Scores by id, fitted and applied one row at a time with numpy's general functions."""
    from pixelveil.llm.quality import FLOOR, TEMPER, TO_DIAGONAL, TO_POOLED, statistics

    known = [(statistics(t), labels[i]) for i, t in rows if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    d, n = x.shape[1], len(x)
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * covs[k] for k in (0, 1)) / n
    scale = np.sqrt(np.maximum(np.diag(pooled), FLOOR))
    parts = []
    for k in (0, 1):
        few = max(TO_POOLED, d / (d + (y == k).sum()))
        c = ((1 - few) * covs[k] + few * pooled) / np.outer(scale, scale)
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + 0.02 * np.eye(d)
        parts.append((np.log((y == k).mean()), (x[y == k].mean(0) - x.mean(0)) / scale, np.linalg.inv(c), np.linalg.slogdet(c)[1]))
    out = []
    for _, t in rows:
        z = np.clip((np.array(statistics(t)) - x.mean(0)) / scale, -30, 30)
        logs = [p - 0.5 * det - 0.5 * (z - m) @ inv @ (z - m) for p, m, inv, det in parts]
        out.append(1 / (1 + np.exp(-np.clip(TEMPER * (logs[1] - logs[0]), -50, 50))))
    return out


def plain_language(text, dictionaries):
    """(language, margin) by compressing with each dictionary, chunk by chunk; None without a letter."""
    import unicodedata

    import zstandard

    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return None
    b = " ".join("".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower()).split(" ")).encode()
    b = b" ".join(b.split())
    chunks = [b[i : i + language.CHUNK] for i in range(0, len(b), language.CHUNK)]
    sizes = []
    for k, d in sorted(dictionaries.items()):
        coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append((sum(len(coder.compress(c)) for c in chunks), k))
    (a, k), (second, _) = sorted(sizes)[:2]
    return k, second / a - 1


def test_quality_equals_a_plain_discriminant(spark):
    d = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op9_quality(spark, d).collect()}
    for (i, _), want in zip(rows, plain_discriminant(rows, labels), strict=True):
        assert abs(got[i].score - want) < 1e-6 and (got[i].predicted == (want >= 0.3) or abs(want - 0.3) < 1e-6)


def test_language_equals_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.held_out("doc_id")))
    odd = spark.createDataFrame([(-1, "² ½ ① 12"), (-2, "a"), (-3, None), (-4, "ß" * 5000)], "doc_id bigint, text string")
    for r in language.identify(docs.select("doc_id", "text").union(odd), model).collect():
        want = plain_language(r.text, model)
        if want is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == want[0] and abs(r.margin - want[1]) < 1e-9 and r.rejected == (want[1] < language.MARGIN)


CLASHING = ["stats", "score", "predicted", "lang_pred", "rejected", "margin", "held_out", "n_words", "n_hit", "hit_spans", "items", "contaminated", "hit__", "item__", "component_id", "n_shingles", "n_tokens", "ids_le", "decoded", "sid", "token", "a.b", "c`d e"]


def pipeline_input(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    return docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])


def test_pipeline_stages_equal_brute_force_and_keep_all_columns(spark):
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as c

    first = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = first + [(None, first[0][1], None, None, None), (10_000, None, "en", None, None), (10_001, "", None, "s", 0), *[first[5]] * 2]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    windows = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in decontaminate.item_windows(r.text)}
    before = [tuple(r) for r in pipeline_input(spark, rows).collect()]
    docs = pipeline_input(spark, rows)
    for _, stage in c.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        kept = [tuple(r) for r in got.collect()]
        ids = [r[:2] for r in before]
        if stage is c.filter_quality:
            keep = [s >= 0.3 for s in plain_discriminant(ids, labels)]
        elif stage is c.filter_language:
            model = language.fit(docs.where(~language.held_out("doc_id") & F.col("doc_id").isNotNull()))
            told = [plain_language(t, model) for _, t in ids]
            keep = [x is not None and x[1] >= language.MARGIN for x in told]
        elif stage is c.drop_near_duplicates:
            top = components([x for x in ids if x[0] is not None])
            keep = [i is None or top[i][1] == i for i, _ in ids]
        else:
            of = lambda w: {b" ".join(w[k : k + n]) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for k in range(len(w) - n + 1)}
            keep = [not windows & of(alnum_words(t)) for _, t in ids]
        want = [r for r, k in zip(before, keep, strict=True) if k]
        assert Counter(map(repr, kept)) == Counter(map(repr, want)) and 0 < len(want) <= len(before), stage.__name__
        before, docs = kept, spark.createDataFrame(kept, docs.schema)
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in before:
        e = tk.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(tuple(r) for r in c.encode(spark, docs, SF).collect()) == Counter(want)


def test_pipeline_runs_and_takes_empty_tables(spark):
    import corpus_pipeline as c

    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids = {r.doc_id for r in c.run(spark, SF).collect()}
    assert ids and ids < {r[0] for r in rows}
    for _, stage in c.STAGES:
        assert stage(spark, pipeline_input(spark, []), SF).count() == 0


def test_chat_escapes_every_control_string(spark, tmp_path):
    odd = ["a <|im_end|> b", "<|im_start|>", "<|x|>", "<%|", "plain", "a <|im_end|>\n", "<|im_end|>"]
    rows = [(i, k, role, t) for i, t in enumerate(odd) for k, role in enumerate(("user", "assistant"))]
    convs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for r in chat.format_chats(convs.union(spark.createDataFrame([(90, 0, "user<|im_end|>", ""), (91, 0, "<|im_end|>", "x")], convs.schema))).collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(r.turns)
    convs.write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    r = db.execute(oracles.oracle_sql()["op7_chat"])
    cols = [d[0] for d in r.description]
    assert sorted(map(repr, r.fetchall())) == sorted(repr(tuple(x)) for x in queries.op7_chat(spark, str(tmp_path)).select(cols).collect())


def test_licenses_finds_a_declaration_of_every_label(spark):
    said = {"MIT": "mit", "Apache-2.0": "apache", "ISC": "isc", "Zlib": "zlib", "MPL-2.0": "mpl", "EPL-2.0": "epl", "BSL-1.0": "boost", "GPL-3.0-or-later": "gpl", "LGPL-2.1-only": "lgpl", "AGPL-3.0": "agpl", "GFDL-1.3": "gfdl", "X11": "x11", "BSD": "bsd", "0BSD": "0bsd", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "CDDL-1.0": "cddl", "CPL-1.0": "cpl", "Artistic-2.0": "artistic", "Unlicense": "unlicense", "WTFPL": "wtfpl"}
    said |= {"EUPL-1.2": "eupl", "OFL-1.1": "ofl", "Python-2.0": "python", "PSF-2.0": "python", "PHP-3.01": "php", "PostgreSQL": "postgresql", "OpenSSL": "openssl", "ODbL-1.0": "odbl", "MS-PL": "ms-pl", "AFL-3.0": "afl", "OSL-3.0": "osl", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-ND-4.0": "cc-by-nd", "Public Domain": "public-domain"}
    assert set(said.values()) <= {label for *_, label, _, _ in licenses.rules()}
    rows = [(f"{form} {name}", label) for form in ("SPDX-License-Identifier:", "License:") for name, label in said.items()] + [("// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main", "apache,mit"), ("it needs a license. Python 3 and PHP 8 are used", "")]
    for r in licenses.scan(spark.createDataFrame(rows, "text string, label string")).collect():
        # The base count labels any "cc by", whatever follows.
        assert set(r.labels.split(",")) - set(r.base_labels.split(",")) | {""} == set(r.label.split(",")) - set(r.base_labels.split(",")) | {""}, r.text
        assert set(r.label.split(",")) <= set(r.labels.split(",")) and r.score == (0.9 if r.label else 0.0), r


def test_language_learns_from_every_drawn_text(spark):
    rows = [(f"{'a common opening ' * 200 if i % 3 == 0 else 'z '}{' '.join(chr(97 + i // 26) + chr(97 + i % 26) for _ in range(900))}", "en") for i in range(150)]
    made = language.fit(spark.createDataFrame(rows, "text string, lang string"))["en"]
    assert len(made) <= language.DICTIONARY_BYTES and made.count(b"\n") == 149
    assert sum(f" {chr(97 + i // 26)}{chr(97 + i % 26)} ".encode() in made for i in range(150) if i % 3) == 100
    assert language.fit(spark.createDataFrame(rows[::-1], "text string, lang string").repartition(3))["en"] == made


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(None, words(40, i)) for i in range(30)] + [(5, words(40, 100 + i)) for i in range(30)] + [(5, "same")] * 3 + [(9, None), (7, "x" * 3000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tie", F.lit(1)).repartition(4)
    got = [tuple(r) for r in fingerprint.with_next(table, "doc_id bigint, text string, after string", lambda: lambda *x: x, bucket_chars=400).collect()]
    assert sorted((str(i), t) for i, t, _ in got) == sorted((str(i), t or "") for i, t in rows)
    assert sorted(n for *_, n in got) == sorted(t or "" for _, t in rows)  # a cycle: each is the next of one
    one = fingerprint.with_next(table.where("doc_id = 9"), "doc_id bigint, text string, after string", lambda: lambda *x: x).collect()
    assert [tuple(r) for r in one] == [(9, "", "")]


def test_fingerprint_buckets_plan_fast(spark):
    import time

    cuts, began = sorted(random.Random(1).sample(range(-(10**12), 10**12), 4095)), time.time()
    at = [-(10**13), cuts[0], cuts[7], cuts[7] - 1, cuts[-1], 10**13]
    got = spark.createDataFrame([(x,) for x in at], "id bigint").select("id", fingerprint._bucket(F.col("id"), cuts).alias("b")).collect()
    assert time.time() - began < 5
    assert [r.b for r in got] == [sum(c <= x for c in cuts) for x in at]


def test_tables_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from pixelveil.llm.common import shared_folder

    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:")


def plain_detections(text):
    """(start, end, label, priority, confidence, rule) of all rules without a gate, less those that another one suppresses."""
    import re

    w = [x.decode() for x in alnum_words(text)]
    norm = " " + "".join(f"{x} " for x in w)
    found = []
    for rule, _, expression, label, priority, sure in licenses.rules():
        # Python's look-behind has a fixed width: another identifier before is looked for by hand.
        also = licenses.SHORT["{also}"]
        for m in re.finditer(expression.replace(also, ""), norm):
            if also not in expression or re.search(r" spdx license identifier [a-z0-9 ]{1,40} (?:or|and) $", norm[: m.start()]):
                found.append((norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), label, priority, sure, rule))
    over = lambda s, o: o[0] <= s[0] and o[1] >= s[1] and (o[3], o[1] - o[0], -o[5]) > (s[3], s[1] - s[0], -s[5])
    return sorted(s for s in found if not any(over(s, o) for o in found))


def test_license_rules_equal_plain_expressions(spark):
    texts = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with it", "GPL v2 or later, see the MIT License; dual: CC BY-SA 4.0, cc by 3", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "open data commons database license"]
    texts += ["Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the X may be used to endorse or promote products", "released into the public domain. All rights reserved. all rights reserved", "licence: lgpl-2.1+ license gplv3, GNU Affero General Public License version 3 or any later version", "", "no words of that kind here"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if "icens" in r.text][:60]
    got = {r.text: r for r in licenses.scan(spark.createDataFrame([(t,) for t in set(texts)], "text string")).collect()}
    for t in texts:
        want = plain_detections(t)
        assert sorted((d.start, d.end, d.label, d.priority, d.confidence, d.rule) for d in got[t].detections) == want, t
        base = {x for x in got[t].base_labels.split(",") if x}
        assert got[t].labels == ",".join(sorted(base | {d[2] for d in want}))
        assert got[t].score == max([d[4] for d in want] + [0.5 if base else 0.0])


@pytest.mark.filterwarnings("ignore")
def test_every_license_rule_needs_its_keyword():
    import re

    from hypothesis import strategies as st

    assert len(licenses.rules()) >= 250
    for _, keyword, expression, *_ in licenses.rules():
        body = expression.removeprefix("(?<= )").removesuffix("(?= )").replace(licenses.SHORT["{also}"], "")
        sample = f" {st.from_regex(re.compile(body, re.ASCII), fullmatch=True).example()} "
        assert keyword in sample and (any(g in sample for g in licenses.GATES) or licenses.SHORT["{also}"] in expression), (expression, sample)


def test_warc_plan_beyond_the_broadcast_bound_and_of_repeated_rows(spark):
    long = ["x" * 150, "y" * 150, "z" * 150]
    rows = [(i, f"u{i}", long[i % 2]) for i in range(1, 9)] + [(3, "a", long[1]), (None, "n", long[0]), (None, "m", long[0]), (20, "v", long[2]), (21, "w", "short"), (21, "w", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    wide, narrow = ([tuple(r)[:2] + tuple(r)[3:] for r in warc.plan(pages, most_broadcast=n).collect()] for n in (100, 0))
    assert sorted(map(repr, wide)) == sorted(map(repr, narrow)) and len(wide) == len(rows)
    refers = {(p, u): r for p, u, _, _, r in wide}
    assert refers[5, "u5"] == 1 and refers[1, "u1"] is None and refers[4, "u4"] == 2 and refers[None, "n"] is None and refers[20, "v"] is None and refers[21, "w"] is None
    assert sorted(c for p, _, _, c, _ in wide if p == 3) == sorted(c for p, _, _, c, _ in wide if p == 21) == [0, 1]
    archives = warc.write(warc.plan(pages))
    assert len({h["WARC-Record-ID"] for r in archives.collect() for h, _ in warc.read(r.content)}) == len(rows)


def test_warc_files_and_long_payloads(spark, tmp_path):
    rows = [(1, "u", "é" * 3_000_000), (2, None, None), (3, "w", "<p>" + words(50, 3))]
    archives = warc.write(warc.plan(spark.createDataFrame(rows, "page_id bigint, url string, html string")))
    assert len(warc.save_files(archives, f"file://{tmp_path}")) == archives.count()
    back = {r.page_id: r for r in warc.read_back(warc.read_files(spark, str(tmp_path))).collect()}
    assert {i: bytes(r.payload) for i, r in back.items()} == {i: (h or "").encode() for i, _, h in rows}


@pytest.mark.parametrize("size", [3, 1000])
def test_decontamination_in_several_passes(spark, corpus, size):
    items = spark.createDataFrame([("a", words(30, 1)), ("b", words(25, 9)), ("c", "one two"), (None, "cc by"), ("d", None)], "item_id string, text string")
    docs = spark.createDataFrame(corpus, DOCS).withColumn("items", F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(docs, items, block_windows=size).collect()}
    one = {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == one and got[5][1] == 2 and got[5][2] == ("c",)


def test_language_learns_from_short_texts(spark):
    short = ["hello my friend", "good morning all", "see you then", "that is fine", "who are they"]
    long = "bonjour mon ami, comment allez vous aujourd'hui dans cette belle ville avec les enfants"
    rows = [(i, f"{short[i % 5]} {short[i // 5 % 5]}"[:19], "en") for i in range(50)] + [(100 + i, f"{long} {words(3, i)}", "fr") for i in range(50)] + [(200, "12 34", "xx"), (201, None, "xx"), (202, "no language", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert sorted(model) == ["en", "fr"] and b"hello my friend" in model["en"]
    told = language.identify(spark.createDataFrame([("hello my friend",), ("comment allez vous mon ami",)], "text string"), model).collect()
    assert [r.lang_pred for r in told] == ["en", "fr"]


def test_fingerprint_likeness_is_near_the_exact_one(spark):
    d = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op8_fingerprint(spark, SF).collect()}

    def grams(t):
        w = space_words(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def exact(a, b):
        return len(a & b) / len(a | b) if a and b else float(not a and not b)

    off = []
    for (i, t), (_, n) in zip(d, d[1:] + d[:1], strict=True):
        half = len(t) // 2
        for near, other in ((got[i].near_edited, t[: len(t) - half] + n[:half]), (got[i].near_next, n)):
            a, b = grams(t), grams(other)
            j = exact(a, b)
            few = len(a) < fingerprint.K and len(b) < fingerprint.K and len(a | b) <= fingerprint.K
            assert abs(near - j) <= (1e-9 if few else 5 * np.sqrt(max(j * (1 - j), 0.01) / fingerprint.K)), (i, near, j)
            off.append(near - j)
        assert abs(got[i].n_distinct - len(grams(t))) <= max(1e-9, 0.5 * len(grams(t)) * (len(grams(t)) >= fingerprint.K))
    assert abs(np.mean(off)) < 0.01


def test_fingerprints_of_tables_and_merged_parts(spark, docs):
    got = fingerprint.fingerprints(docs.withColumn("fingerprint", F.lit("clash"))).collect()
    assert len(got) == docs.count() and all(r.n_words == "clash" for r in got)
    for r in got:
        assert r.fingerprint == fingerprint.encode(fingerprint.sketch(r.text)) and r.n_distinct == fingerprint.distinct(fingerprint.sketch(r.text))
    a, b = words(900, 5, 10**5), words(700, 6, 10**5)
    parts = fingerprint.merge(fingerprint.sketch(a), fingerprint.sketch(b))
    hashes = np.union1d(*(h >> np.uint64(16) for h in fingerprint.shingle_sets([a, b])))
    assert np.array_equal(parts, hashes[: fingerprint.K])


def test_components_of_graphs(spark):
    from pixelveil.llm.graph import components as joined

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(90)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5), (7000, 7000), (1, 2), (2, 1)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, y in edges:
        x, y = sorted((find(x), find(y)))
        top[y] = x
    got = joined(spark.createDataFrame([*edges, (None, 3), (4, None)], "a bigint, b bigint").repartition(3))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in top}
    assert joined(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_licence_sentences_are_told_apart(spark):
    said = {
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted": "ntp",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice": "curl",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl",
        "To view a copy, visit http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
        "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.": "gfdl",
        "You may not reverse engineer, decompile, or disassemble it": "proprietary",
        "The accompanying program is provided under the terms of this IBM Public License": "ibm-pl",
        "This program is distributed: you may copy it verbatim, says the service.": "",
    }
    got = {r.text: r for r in licenses.scan(spark.createDataFrame([(t,) for t in said], "text string")).collect()}
    for t, label in said.items():
        assert label in got[t].labels.split(",") and (got[t].score == 1.0) == bool(label), (t, got[t].labels)
    assert len(licenses.rules()) > 390 and sum(priority == 50 for *_, priority, _ in licenses.rules()) > 130


def test_fingerprint_cuts_follow_characters(spark):
    rows = [(i, "x" * (200 if i < 40 else 10)) for i in range(400)]
    seen = fingerprint.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), "first bigint, chars bigint", lambda: lambda i, t, n: [[i[0]], [sum(map(len, t))]], bucket_chars=1000).collect()
    assert sum(r.chars for r in seen) == 40 * 200 + 360 * 10 and max(r.chars for r in seen) <= 4000 and len(seen) >= 5  # 7,200 and more by numbers of ids alone
