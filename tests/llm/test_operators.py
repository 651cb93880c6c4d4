"""Every operator on small rows: brute force, round trips, and nulls, empties, repeats and clashes."""

from __future__ import annotations

import collections
import gzip
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderlens.llm import catalog, decontamination, language_model, near_dedup, personal_data, pieces, search, secrets
from orderlens.llm import toxicity, url_rules, warc
from orderlens.llm.components import components
from orderlens.llm.storage import shared_folder

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double, kept boolean, words string"
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"


def frame(spark, texts, schema=ODD):
    extra = (None, None, None, "k", 1.0, True, "w")
    return spark.createDataFrame([(i, t, *extra) for i, t in texts], schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta,", "theta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(20_000))
    odd = [None, "", " \n ", texts[3], texts[3], PROSE, PROSE + " eighteen", PROSE.upper(), long, "x" * 5_000]
    return [*enumerate([*texts, *odd]), (5, texts[5]), (None, PROSE), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join(PROSE.split()[2:14])), (2, "beta zeta"), (3, None), (4, "--"), (None, "delta delta delta"), (2, "beta zeta")]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (100_000, 11):
        got = decontamination.contamination(decontamination.match_items(docs, items, block_words=block)).collect()
        for (doc_id, text), row in zip(rows, got, strict=True):
            words, hit, found = words_of(text), set(), set()
            for item_id, item in [(r[0], words_of(r[1])) for r in items.collect()]:
                n = min(10, len(item))
                windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else ()
                for i in range(len(words) - n + 1):
                    if tuple(words[i : i + n]) in windows:
                        hit.update(range(i, i + n))
                        found |= {str(item_id)} - {"None"}
            assert (row.doc_id, row.n_words, row.n_hit, row.n_items) == (doc_id, len(words), len(hit), len(found))
    clean = decontamination.decontaminated(docs, items)
    assert clean.columns == docs.columns
    after = decontamination.contamination(decontamination.match_items(clean, items))
    assert not after.where("contaminated").count()
    untouched = {i for (i, t), r in zip(rows, got, strict=True) if not r.contaminated}
    assert untouched <= {r.doc_id for r in clean.collect()}
    none = items.limit(0)
    assert decontamination.match_items(docs, none).where("size(runs) > 0").count() == 0
    assert decontamination.match_items(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_warc_round_trip(spark, split):
    pages = [(3, "http://a\r\n%41", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "é", "é" * 9000), (3, "u", "same"), (None, "n", "same")]
    rng = random.Random(1)
    pages += [(i, f"u{i}", "".join(rng.choice("abc<>é") for _ in range(rng.randint(0, 900)))) for i in range(10, 60)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    manifest = warc.write_archives(warc.with_originals(frame), shared_folder(spark, "w"), file_bytes=4000)
    got = warc.read_archives(spark, manifest, split_bytes=split, with_payload=True).collect()
    assert len(got) == len(pages)
    assert sorted((r.page_id, r.url or "") for r in got if r.page_id) == sorted((i, u or "") for i, u, _ in pages if i)
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert (by[1].record_type, by[3].record_type, by[3].refers_to) == ("response", "revisit", 1)
    assert (by[2].record_type, by[4].refers_to, by[4].payload_bytes) == ("response", 2, 0)
    assert by[5].payload.decode() == "é" * 9000 and by[3].payload_bytes == 4
    assert warc.read_archives(spark, manifest.limit(0)).count() == 0


@pytest.mark.parametrize("split", [10_000, 1 << 20])
def test_warc_reads_long_headers(spark, split):
    """Urls that pack well and badly, as first record of a file (each has one) and of a range."""
    rng = random.Random(13)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(300_000))
    pages = [(1, "http://a/" + "x" * 100_000, "one"), (2, "http://b/" + noise, "two"), (3, "http://c/" + noise[:65_400], "three")]
    for file_bytes in (1, 1 << 20):
        frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
        manifest = warc.write_archives(warc.with_originals(frame), shared_folder(spark, "w"), file_bytes=file_bytes)
        got = warc.read_archives(spark, manifest, split_bytes=split, with_payload=True).collect()
        assert sorted((r.page_id, r.url, r.payload.decode()) for r in got) == pages


@pytest.mark.parametrize("split", [150, 1 << 20])
def test_warc_tells_of_damage(spark, tmp_path, split):
    """A record damaged in its header or its payload, a file cut short, bytes between records: all other records are read."""
    record = lambda i: warc._record(i, f" http://{i}\t ", bytes(random.Random(i).randbytes(300)), "D", None, "2024-01-01T00:00:00Z")
    records = [record(i) for i in range(5)]
    spoilt = lambda data, at: data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
    cases = {
        "whole": (records, {0, 1, 2, 3, 4}, None),
        "head": ([*records[:2], spoilt(records[2], 12), *records[3:]], {0, 1, 3, 4}, 2),
        "first": ([spoilt(records[0], 0), *records[1:]], {1, 2, 3, 4}, 0),
        "payload": ([*records[:3], spoilt(records[3], len(records[3]) - 30), records[4]], {0, 1, 2, 4}, 3),
        "between": ([*records[:2], b"xx", *records[2:]], {0, 1, 2, 3, 4}, 2),
        "cut": ([*records[:4], records[4][:-9]], {0, 1, 2, 3}, 4),
        "lost end": (records[:4], {0, 1, 2, 3}, 4),
    }
    for name, (parts, whole, place) in cases.items():
        path = tmp_path / f"{name.replace(' ', '-')}.warc.gz"
        path.write_bytes(b"".join(parts))
        stated = sum(map(len, records)) if name == "lost end" else path.stat().st_size
        files = spark.createDataFrame([(str(path), stated)], "path string, bytes bigint")
        got = warc.read_archives(spark, files, split_bytes=split, report_damage=True).collect()
        assert {(r.page_id, r.url) for r in got if r.record_type == "response"} == {(i, f" http://{i}\t ") for i in whole}
        damaged = [r.url for r in got if r.record_type == warc.DAMAGED]
        assert damaged == ([] if place is None else [f"{path}:{sum(map(len, parts[:place]))}"])
        if place is not None:
            with pytest.raises(Exception, match="damaged archive"):
                warc.read_archives(spark, files, split_bytes=split).collect()


def test_warc_takes_no_other_member_for_a_record(tmp_path):
    """Members that are no record, or end within the header, are passed over."""
    record = warc._record(7, "u", b"text", "D", None, "2024-01-01T00:00:00Z")
    pack = lambda data: gzip.compress(data)
    other = [pack(b""), pack(b"WARC"), pack(b"WARC/1.1\r\nA: b\r\n"), pack(b"plain\r\n\r\n" * 9000), warc.MAGIC]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(other) + record)
    got = list(warc.records_in(str(path), 0, path.stat().st_size))
    assert [h["warc-record-id"] for h, _ in got] == ["<urn:page:7>"]


def test_language_model(docs, rows):
    held = catalog.in_fold(F.col("doc_id"), 7, 2)
    training = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    seen = collections.Counter(w for t in training for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    model = language_model.count_filter(docs.where(~held))
    assert (model.n_tokens, model.n_distinct) == (n, v)
    small = language_model.CountFilter(model.segments, model.shift, model.base, 2, 2000)
    assert small.n_shards > 1
    one, many = (language_model.scored(docs, m).collect() for m in (model, small))
    assert one == many
    for (i, t), r in zip(rows, one, strict=True):
        exact = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t))
        assert (r.doc_id, r.n_tokens, r.n_known) == (i, len(tokens(t)), sum(w in seen for w in tokens(t)))
        assert r.base_score == pytest.approx(exact) and r.score < 0
    empty = language_model.count_filter(docs.limit(0))
    assert language_model.scored(docs, empty).agg(F.max("base_score")).first()[0] == 0


def test_toxicity(spark):
    rng = random.Random(2)
    text = lambda bad: " ".join(rng.choice(["fine", "day", "tree", "walk"]) for _ in range(20)) + (" scum!" if bad else "")
    docs = frame(spark, [(i, text(i % 6 == 0)) for i in range(600)] + [(None, "scum"), (601, None), (602, ""), (1, "x")])
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 600, 2)] + [(2, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") < 400)
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in range(400, 600)) and got[None] >= 0.5 > got[601] == got[602]
    repeated = docs.crossJoin(spark.range(40).select("id")).drop("id").repartition(3)
    again = toxicity.train(repeated, labels, F.col("doc_id") < 400)
    assert again.weights == model.weights and again.bias == model.bias
    untrained = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert toxicity.scored(docs, untrained).agg(F.max("toxic_score")).first()[0] == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_pieces_equal_the_library(spark, docs, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    vocabulary = pieces.read_vocabulary()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    texts = [t for _, t in rows] + ["".join(rng.choice("aab the\n é😀▁") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    ids, counts = pieces.encode_texts(vocabulary, texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == model.encode(text or "")
    got = catalog.piece_rows(docs).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    apart = pieces.decoded(pieces.encoded(docs, vocabulary), vocabulary)
    at_once = pieces.round_trip(docs, vocabulary)
    assert apart.columns == at_once.columns and sorted(map(repr, apart.collect())) == sorted(map(repr, at_once.collect()))


def test_pieces_kept_between_batches(rows, monkeypatch):
    """Kept units, and forgetting them, change no result."""
    vocabulary = pieces.read_vocabulary()
    texts = [t for _, t in rows]
    whole = pieces.encode_texts(vocabulary, texts)
    for kept in (1 << 21, 0):
        monkeypatch.setattr(pieces, "KEPT_BYTES", kept)
        encoder = pieces.Encoder(vocabulary)
        parts = [encoder.encode(texts[i : i + 7]) for i in range(0, len(texts), 7)]
        for i in range(2):
            assert np.array_equal(np.concatenate([p[i] for p in parts]), whole[i])


def test_near_duplicates(spark, docs, rows):
    rng = random.Random(6)
    base = [str(rng.random()) for _ in range(200)]
    more = []
    for i in range(100, 400):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = str(rng.random())
        more.append((i, " ".join(copy)))
    every = [*rows, *more, *((i, more[0][1]) for i in range(500, 560))]
    got = near_dedup.near_duplicates(frame(spark, every)).collect()
    sets, parent = collections.defaultdict(list), {i: i for i, _ in every}
    for i, t in every:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, own in sets.items() if i is not None for s in own if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert len(got) == len(every)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (find(r.doc_id), r.doc_id == find(r.doc_id))
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_key_plan_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    plan = near_dedup.key_plan()
    for _ in range(300):
        errors = set(rng.choice(near_dedup.SYMBOLS, near_dedup.RADIUS, replace=False).tolist())
        assert any(not errors & set(used.tolist()) for used in plan)


def pair_of(rng, shingles, changes):
    """Two texts whose sets have this many shingles each; each change costs both sides five of them."""
    words = [str(rng.random()) for _ in range(shingles + 4)]
    copy = list(words)
    for k in range(changes):
        copy[10 + 10 * k] = str(rng.random())
    return " ".join(words), " ".join(copy)


def test_stage_links_from_80_hundredths_on(spark, folder):
    """202 shingles: four changes leave 182 of 222 (0.82), three 0.86, five 0.78."""
    rng = random.Random(12)
    texts = [pair_of(rng, 202, (4, 3, 5)[k % 3]) for k in range(24)]
    docs = frame(spark, [(2 * k + i, t) for k, pair in enumerate(texts) for i, t in enumerate(pair)])
    stage = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()}
    query = {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()}
    assert stage == {2 * k for k in range(24)} | {2 * k + 1 for k in range(24) if k % 3 == 2}
    assert query == {2 * k for k in range(24)} | {2 * k + 1 for k in range(24) if k % 3 != 1}
    plan = near_dedup.key_plan(radius=corpus_pipeline.NEAR_RADIUS)
    draws = np.random.default_rng(2)
    for _ in range(300):
        errors = set(draws.choice(near_dedup.SYMBOLS, corpus_pipeline.NEAR_RADIUS, replace=False).tolist())
        assert any(not errors & set(used.tolist()) for used in plan)


def test_confirmed_links_ask_nothing_of_signatures(spark):
    """Sets 0.9 alike in one group link although their signatures differ in every symbol; 0.8 alike do not."""
    sets = [np.arange(0, 950), np.arange(50, 1000), np.arange(5000, 5900), np.arange(5100, 6000)]
    rows = [
        (k // 2, 0, 0, k, np.full(near_dedup.SYMBOLS, k, dtype=np.uint16).tobytes(), s.astype(np.uint64).tobytes())
        for k, s in enumerate(sets)
    ]
    rows = spark.createDataFrame(rows, "component bigint, b1 bigint, b2 bigint, id bigint, signature binary, shingles binary")
    assert [(r.a, r.b) for r in near_dedup.confirmed_links(rows).collect()] == [(0, 1)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 90), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


def test_url_rules(spark):
    rules = [*catalog.URL_RULES, ("block", "www.bad.com", ""), ("allow", "bad.com", "/x/y"), ("allow", "", ""), ("block", "t.org", "/a"), ("allow", "t.org", "/a"), (None, "z", ""), ("allow", None, "/")]
    rng = random.Random(8)
    hosts = ["Example.ORG", "a.example.org", "bad.com", "www.bad.com", "m.www.bad.com", "t.org", "xexample.org", "com", ""]
    paths = ["", "/", "/es/", "/es", "/en/12", "/en/2", "/de/1", "/fr/q?x=/de/", "/x/y", "/x/yz/1", "/a#b", "/de"]
    urls = [f"{rng.choice(['http', 'x', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no url", "a://b://c/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    one, many = (url_rules.judged(pages, rules, trie_rules=n).collect() for n in (200_000, 2))
    assert one == many
    for r, url in zip(one, urls, strict=True):
        host, path = url_rules.split_url(url)
        fit = [x for x in rules if x[0] and x[1] is not None and (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fit, key=lambda x: (len(x[1] + x[2]), len(x[1]), x[0] == "block"), default=("allow", "", None))
        assert (r.host, r.path, r.verdict, r.rule) == (host, path, best[0], best[1] + best[2] if best[2] is not None else None)


SECRETS = [
    "token = 'abcdefgh' PASSWORD:short secret=token:abcdefghij api_key='x'", "AKIA" + "A1" * 8 + " AKIAX", "0" * 40 + "é" + "f" * 31,
    "token=" + "a" * 10 + " é😀 api-key: q token : \"0123456789abcdef0123456789abcdef\"", None, "", "plain words only",
]


def test_secrets(spark):
    docs = frame(spark, list(enumerate(SECRETS * 2)))
    ratios = secrets.log_ratios(docs)
    got = secrets.with_spans(docs, ratios).select("doc_id", secrets.joined_spans("base_spans").alias("s"), "spans").collect()
    for r, text in zip(got, SECRETS * 2, strict=True):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text or "", re.I | re.A) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
        assert r.s == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    masked = secrets.redacted(docs, ratios)
    assert masked.columns == docs.columns and masked.where("doc_id = 2").first().text == secrets.MARK + "é" + "f" * 31
    assert [r.text for r in masked.collect()][4:7] == [None, "", "plain words only"]
    assert secrets.redacted(docs.limit(0), secrets.log_ratios(docs.limit(0))).count() == 0


LONG_UNITS = {
    "mixed": lambda r, n: "".join(r.choice(["the", "return", "größe", "東京", "😀", "\x00", "==", "é", "Q7"]) for _ in range(n // 4)),
    "letters": lambda r, n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(n)),
    "period of 6": lambda r, n: ("abcabd" * n)[:n],
    "period of 7": lambda r, n: ("x" + "a" * 6) * (n // 7),
    "one letter": lambda r, n: "=" * n,
    "spaces": lambda r, n: "x" + " " * n + "y",
    "characters without a piece": lambda r, n: "".join(chr(r.randint(0x1F300, 0x1F9FF)) for _ in range(n // 4)),
}


@pytest.mark.parametrize("kind", LONG_UNITS)
def test_sentencepiece_long_units_equal_the_library(monkeypatch, kind):
    """Units longer than lanes and sections, with lanes that agree at once, late or never."""
    import sentencepiece

    model, vocabulary = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.read_vocabulary()
    stepped = []
    plain = pieces._Long._step_by_step
    monkeypatch.setattr(pieces._Long, "_step_by_step", lambda self, *args: (stepped.append(args[0]), plain(self, *args)))
    rng = random.Random(4)
    for long, lane, warm, block in ((8192, 1024, 256, 1 << 18), (200, 100, 30, 450), (60, 37, 0, 111)):
        for name, value in zip(("LONG_BYTES", "LANE_BYTES", "WARM_BYTES", "BLOCK_BYTES"), (long, lane, warm, block), strict=True):
            monkeypatch.setattr(pieces, name, value)
        for n in (long - 1, long, 3 * long, 2 * block + 1 if block < 1000 else 30_000):
            texts = ["b c", LONG_UNITS[kind](rng, n), "", None, LONG_UNITS[kind](rng, n) + " d " + LONG_UNITS[kind](rng, n)]
            ids, counts = pieces.encode_texts(vocabulary, texts)
            want = [model.encode(t or "") for t in texts]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert stepped, "no lane disagreed"


def test_sentencepiece_of_5_mb_without_a_space():
    vocabulary, text = pieces.read_vocabulary(), LONG_UNITS["letters"](random.Random(6), 5_000_000)
    start = time.monotonic()
    ids, counts = pieces.encode_texts(vocabulary, [text])
    assert time.monotonic() - start < 150
    assert pieces.decode_ids(vocabulary, ids, counts) == [text]


def test_secrets_of_a_text_with_very_many_matches(spark):
    """Spans, runs that overlap none of them, and redaction, against plain code; block edges included."""
    rng = random.Random(8)
    parts = ["token=abcdefgh1", "0" * 33, "AKIA" + "B2" * 9, "secret: " + "0a" * 20 + "/x", "Zq8Xp2Lm9Kd3Rt7VbN4w1", "é word", "token=AKIA" + "C3" * 8]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (255, 256, 257, 511, 513, 1200, 40_000)]
    docs = frame(spark, list(enumerate(texts)))
    ratios = [1.0] * secrets.CODES**2  # every run is a secret
    start = time.monotonic()
    found = secrets.with_spans(docs, ratios).select("doc_id", "base_spans", "spans").orderBy("doc_id").collect()
    masked = [r.text for r in secrets.redacted(docs, ratios).orderBy("doc_id").collect()]
    assert time.monotonic() - start < 90
    for row, text, new in zip(found, texts, masked, strict=True):
        base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{12,}", text)]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{32,}", text)]
        assert [tuple(s) for s in row.base_spans] == sorted(base)
        inside = bytearray(len(text))
        for a, _, b in base:
            inside[a:b] = b"\1" * (b - a)
        spans = sorted(base + [(m.start(), 3, m.end()) for m in re.finditer(secrets.RUNS, text) if not any(inside[m.start() : m.end()])])
        assert [tuple(s) for s in row.spans] == spans
        at, out = 0, []
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], secrets.MARK]
            at = max(at, b)
        assert new == "".join(out) + text[at:]


def test_markov_adds_random_strings_only(spark):
    rng = random.Random(5)
    syllable = lambda: rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiouy")
    word = lambda: rng.choice([str.lower, str.upper, str.title])("".join(syllable() for _ in range(rng.randint(2, 6))))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    known = [
        (i, f"token = '{''.join(rng.choice(letters) for _ in range(40))}' " + " ".join(word() for _ in range(60))) for i in range(60)
    ]
    docs = frame(spark, [*known, (99, "q Zq8Xp2Lm9Kd3Rt7VbN4w bacodelifonupasevizokuma")])
    row = secrets.with_spans(docs, secrets.log_ratios(docs)).where("doc_id = 99").select(secrets.joined_spans("spans")).first()
    assert row[0] == "markov:2:22"


def test_personal_data(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("a.@-1 2+0(é") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "+1 (017) 555-7713 a@b.c 1.2.3.256 4" + "0" * 15]
    fixed = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def right(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == 1:
            return all(int(p) <= 255 for p in value.split("."))
        if kind == 2:
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 8 <= len(digits) <= 15

    for t in texts:
        expected = [(k, *m.span()) for k, p in enumerate(fixed) for m in re.finditer(p, t or "") if right(k, m[0])]
        assert personal_data.base_spans(t or "") == expected
    docs = spark.createDataFrame(
        [(i, f"please call me at (03{i % 10}) 555-12{i % 10}4, thanks" if i % 2 else f"page {1000000 + i} of it") for i in range(60)], "doc_id int, text string"
    )
    got = personal_data.found(docs, personal_data.train(docs)).collect()
    assert all(bool(r.spans) == bool(r.doc_id % 2) for r in got)
    assert personal_data.found(docs, personal_data.train(docs.limit(0))).where("size(spans) > 0").count() == 0


def test_automaton_is_linear_in_a_repeated_word():
    """An item and a text of one word, at the size of a whole block, take seconds, not minutes."""
    n = 100_000
    automaton = decontamination.ItemAutomaton()
    automaton.add("a", [b"x"] * n)
    automaton.add("b", [b"x"] * 10 + [b"y"])
    start = time.monotonic()
    automaton.finish()
    for text in ([b"x"] * n, [b"x", b"y"] * n, [b"z"] + [b"x"] * 12 + [b"y"]):
        seen, runs, items = automaton.hits(iter([text]))
        assert seen == len(text)
    assert time.monotonic() - start < 20
    assert runs == [(1, 14)] and items == {"a", "b"}
    assert automaton.hits(iter([[b"x"] * 9 + [b"z"]]))[1:] == ([], set())


def test_search(spark, docs, rows):
    got = collections.defaultdict(list)
    for r in search.top_k(docs, F.col("doc_id") % 4 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    bags = [(i, collections.Counter((t or "").encode().lower().split())) for i, t in rows]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = collections.Counter(w for _, b in bags for w in b)
    for q, bag in bags:
        if q is None or q % 4:
            continue
        scores = []
        for i, b in bags:
            norm = 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + norm) for w in bag if w in b)
            if i is not None and s > 0:
                scores.append((-s, i))
        want = sorted(scores)[:5]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want])
    assert search.top_k(docs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_search_ids_and_ties(spark, monkeypatch, kind):
    """Ids, ranks and ties over many small shards and blocks, with ids of both kinds."""
    monkeypatch.setattr(search, "SHARD_BYTES", 1500)
    monkeypatch.setattr(search, "BLOCK_DOCS", 2)
    monkeypatch.setattr(search, "SLICE_BYTES", 400)
    monkeypatch.setattr(search, "SEED_BLOCKS", 1)
    monkeypatch.setattr(search, "ROUND_BLOCKS", 1)
    monkeypatch.setattr(search, "BLOCK_TERMS", 60)
    rng = random.Random(8)
    rare = [f"r{i}" for i in range(300)]
    texts = [" ".join(rng.choices(["the", "of", "and", *rng.sample(rare, 6)], k=rng.randint(1, 25))) for _ in range(200)]
    texts += texts[:60] + [texts[0]] * 12
    ids = [i if kind == "bigint" else f"d{i}" for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").repartition(3)
    queries = set(ids[:20])
    got = collections.defaultdict(list)
    for r in search.top_k(docs, F.col("doc_id").isin(list(queries)), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    bags = {i: collections.Counter(t.split()) for i, t in zip(ids, texts, strict=True)}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = collections.Counter(w for b in bags.values() for w in b)
    for q in queries:
        scores = []
        for i, b in bags.items():
            norm = 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + norm) for w in bags[q] if w in b)
            if s:
                scores.append((-round(s, 9), i))
        assert got[q] == [i for _, i in sorted(scores)[:7]]


def test_pipeline(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.withColumn("score", F.lit(1)).withColumn("kept", F.lit("x"))
    odd = extra.limit(3).withColumn("text", F.lit(None).cast("string"))
    docs = extra.union(extra.limit(5)).union(odd.withColumn("doc_id", F.lit(None).cast("bigint")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert kept.columns == docs.columns
        before, after = {r.doc_id for r in docs.collect()}, [r.doc_id for r in kept.collect()]
        assert set(after) <= before and len(after) > 0.7 * len(before)
        if name == "near_dedup":
            named = [i for i in after if i is not None]
            assert len(named) == len(set(named)) and None in after
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.where("round_trip").count() == docs.count()


def shingles_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plainly_distinct(rows):
    """The rows (doc_id, text) that the near-dedup stage keeps, by comparing all pairs."""
    named = [(i, t, shingles_of(t)) for i, t in rows if i is not None]
    root = list(range(len(named)))
    for x, (i, t, a) in enumerate(named):
        for y in range(x):
            j, u, b = named[y]
            if 100 * len(a & b) >= 80 * len(a | b) if a or b else (i, t) == (j, u):
                root = [root[x] if r == root[y] else r for r in root]
    groups = collections.defaultdict(list)
    for r, (i, t, _) in zip(root, named, strict=True):
        groups[r].append((i, t))
    return [*([i, t] for i, t in rows if i is None), *([min(i for i, _ in g), {t for i, t in g if i == min(g, key=lambda x: x[0])[0]}] for g in groups.values())]


def test_repeated_ids_with_different_texts(spark, folder):
    """Rows that share a doc_id stay unless their texts are alike; a null text wins over nothing."""
    rng = random.Random(14)
    (a, near_a), (b, _), (c, near_c) = (pair_of(rng, 202, 3) for _ in range(3))
    rows = [(1, a), (2, near_a), (2, b), (3, None), (3, c), (3, c), (3, None), (4, None), (5, ""), (5, " "), (5, ""), (6, near_c), (6, near_c), (None, a), (None, None)]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), folder)
    want = [(1, a), (2, b), (3, None), (3, c), (4, None), (5, ""), (5, " "), (None, a), (None, None)]
    assert got.columns == frame(spark, rows).columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


def test_pipeline_run_equals_its_stages_done_plainly(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(80)]
    prose = lambda n=80: [rng.choice(vocabulary) for _ in range(n)]
    item = " ".join(f"item{k}" for k in range(14))
    rows = []
    for i in range(240):
        words = prose()
        if i % 6 == 0:
            words[5::10] = ["scum!"] * 8
        elif i % 6 == 1:
            words[40] = item
        elif i % 6 == 2:
            words[20] = "AKIA" + "A1" * 8
        elif i % 12 == 3:
            words = [item, "short", "text"]
        rows.append((i, " ".join(words)))
        if i % 6 in (4, 5):
            words[rng.randrange(80)] = "new"
            rows.append((rng.choice([i, 1000 + i]), " ".join(words)))
        if i % 8 == 7:
            rows += [(i, " ".join(prose())), (i, None), (i, None), (None, rows[-1][1]), (i, rows[-1][1])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 6 == 0)) for i in range(0, 240)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    kept = plainly_distinct([(i, t) for i, t in rows if "scum!" not in (t or "")])
    want = []
    for i, texts in kept:
        options = texts if isinstance(texts, set) else {texts}
        cut = [t if t is None else t.replace(item, "\n") for t in options if not (t or "").endswith(" short text")]
        masked = [re.sub("AKIA[A-Z0-9]{16}", secrets.MARK, t or "") for t in cut]
        if masked:
            want.append((i, {tuple(model.encode(t)) for t in masked}))
    assert len(got) == len(want) and all(r.round_trip for r in got)
    for r in got:
        fit = next((w for w in want if w[0] == r.doc_id and tuple(r.ids) in w[1]), None)
        assert fit, (r.doc_id, r.n_pieces)
        want.remove(fit)
