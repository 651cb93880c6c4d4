"""Byte pairs, spelling variants and token alignment: against the libraries, brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderlens.llm import byte_pairs, catalog, spelling, token_alignment, url_rules

ODD = "doc_id bigint, text string, ids string, slice string, digest string, word string, n bigint, cell int, source string"
EXTRA = ("i", "s", "d", "w", 1, 2, "k")


def frame(spark, rows, schema=ODD):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    syllables = ["ta", "no", "ré", "lin", "Go", "ß", "üm", "the", "er", "x"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(40)]
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x10000, 0x1F000)])) for _ in range(60)) for _ in range(40)]
    odd = [None, "", " ", "\n\n  a\t", "<|endoftext|> <s>", "a▁b", "日本語" * 90, "\x00\x1c\x85", "'s'll I'd", texts[0], texts[0], "x" * 700]
    long = " ".join(word() for _ in range(60_000)) + "".join(rng.choice("abcdé") for _ in range(40_000))
    return [*enumerate([*texts, *wild, *odd, long]), (3, texts[3]), (None, texts[1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def tables(ranks):
    return byte_pairs.tables(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_equal_the_library(spark, docs, rows, tables, library):
    got = byte_pairs.round_trip(docs, tables, names=("ids", "raw"))
    assert got.columns == [*(c for c in docs.columns if c != "ids"), "ids", "raw"]
    for (doc_id, text), row in zip(rows, got.collect(), strict=True):
        assert (row.doc_id, row.text, row.ids) == (doc_id, text, library.encode_ordinary(text or ""))
        assert bytes(row.raw) == (text or "").encode()
    alone = byte_pairs.decoded(byte_pairs.encoded(docs.select("doc_id", "text"), tables), tables, name="text")
    assert alone.columns == ["doc_id", "ids", "text"]
    assert [(r.doc_id, bytes(r.text)) for r in alone.collect()] == [(i, (t or "").encode()) for i, t in rows]
    assert byte_pairs.round_trip(docs.limit(0), tables).count() == 0


def test_byte_pair_trees_on_their_own(tables, library):
    """Ties, repeated letters, and every width, with steps taken together and alone."""
    rng = random.Random(2)
    matches = ["a" * n for n in range(1, 80)] + ["ab" * n for n in range(1, 60)]
    matches += ["".join(rng.choice("etaoinéß") for _ in range(rng.randint(1, 300))) for _ in range(800)]
    raw = [m.encode() for m in matches]
    ids, counts = byte_pairs.encode_matches(tables, raw)
    ends = np.cumsum(counts)
    for m, a, b in zip(matches, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(m)
        if len(m) > 1 and m.encode() not in tables["ranks"]:
            assert byte_pairs.merge_alone(tables, m.encode()).tolist() == ids[a:b].tolist()


def test_byte_pairs_know_tiktoken_classes_and_forget(tables, library, monkeypatch):
    rng = random.Random(3)
    odd = sorted(tables["substitutes"])
    texts = ["".join(rng.choice(["a", "1", " ", "\n", *map(chr, rng.sample(odd, min(3, len(odd))))]) for _ in range(40)) for _ in range(300)]
    monkeypatch.setattr(byte_pairs, "KEPT_MATCHES", 20)
    monkeypatch.setattr(byte_pairs, "LISTED_CHARS", 10)
    monkeypatch.setattr(byte_pairs, "LISTED", 3)
    encoder = byte_pairs.Encoder(tables)
    for a in range(0, len(texts), 30):
        ids, counts = encoder.encode(texts[a : a + 30])
        assert ids.tolist() == [i for t in texts[a : a + 30] for i in library.encode_ordinary(t)]


def test_byte_pairs_need_every_byte(ranks):
    with pytest.raises(ValueError):
        byte_pairs.tables({k: v for k, v in ranks.items() if k != b"\x07"}, public_tokenizers.PATTERN)


def counted(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                n[word] += 1
    return {w: k for w, k in n.items() if k >= 2}


def edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(n):
    near = {w: [v for v in n if edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in best.items() if n[f] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items()}


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(6, 11))) for _ in range(25)]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 30, 400])
        for _ in range(12):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdeÀ") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
            words += [v.upper() if rng.random() < 0.1 else v] * rng.choice([1, 2, 3, 25])
    words += ["abcdefgh" * 4000] * 3 + ["abcdefgh" * 4000 + "i"] * 40  # very long words
    rng.shuffle(words)
    texts = [(i % 50 if i % 7 else None, ("×" + rng.choice([" ", "\n", "9"])).join(words[i : i + 40])) for i in range(0, len(words), 40)]
    texts += [(1, None), (2, ""), (None, None), (3, "short ones")]
    docs = frame(spark, texts)
    n = counted(texts)
    want = plain_variants(n)
    for cell in (spelling.CELL, 9):
        got = spelling.variants(spelling.word_counts(docs), cell)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(n) and set(found) == want
    assert any(form and root != form for _, form, root, *_ in want)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.where("text IS NULL")).count() == 0


def test_spelling_long_chains_and_equal_vectors(spark):
    """Forms of forms over many steps, and a leaf of many words with the same letters."""
    chain = [("a" * 8 + "b" * i, 2 * 10**i) for i in range(9)]
    rng = random.Random(5)
    same = {"".join(rng.sample("abcdefghij", 10)) for _ in range(700)}
    same = [(w, 3) for w in sorted(same)] + [(w[:-1] + "k", 40) for w in sorted(same)[:20]]
    words = dict(chain + same)
    frame_ = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert {tuple(r) for r in spelling.variants(frame_, 50).collect()} == plain_variants(words)


def plain_alignment(rows):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = token_alignment._byte_letters()
    a_bytes = lambda i: bytes(letters[c] for c in a_model.id_to_token(i))

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    per, n = [], collections.Counter()
    for doc_id, text in rows:
        a, b = [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            if {b"".join(map(a_bytes, a)), b"".join(map(b_bytes, b))} != {(" " + text).encode()}:
                a, b = [], []
        links, groups, left, right = [], [], [], []
        size_a = size_b = i = j = 0
        while i < len(a) or j < len(b):
            if size_a <= size_b and i < len(a):
                size_a, i = size_a + len(a_bytes(a[i])), i + 1
                left.append(a[i - 1])
                if size_b > size_a - len(a_bytes(a[i - 1])):
                    links.append((a[i - 1], b[j - 1]))
            else:
                size_b, j = size_b + len(b_bytes(b[j])), j + 1
                right.append(b[j - 1])
                links.append((a[i - 1], b[j - 1]))
            if size_a == size_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        n.update(links)
        per.append((doc_id, len(a), len(b), links, groups))
    best = collections.defaultdict(int)
    for (_, y), k in n.items():
        best[y] = max(best[y], k)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return collections.Counter(
        (i, a, b, len(g), len(links), sum(n[p] == best[p[1]] for p in links), sum(n[p] for p in links), digest(g))
        for i, a, b, links, g in per
    )


@pytest.mark.parametrize("slice_bytes", [300, 1 << 25])
def test_alignment_equals_a_plain_walk(spark, docs, rows, slice_bytes, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", slice_bytes)
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    models = token_alignment.read_tokenizers(a, b)
    got = token_alignment.measures(docs, models)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = collections.Counter(tuple(r) for r in got.collect())
    assert found == plain_alignment(rows)
    odd = [r for r in found if r[1] == 0]
    assert any(r[0] == 85 for r in odd)  # a literal U+2581 is not what B decodes to
    assert token_alignment.measures(docs.limit(0), models).count() == 0
    assert token_alignment.measures(docs.where("text IS NULL"), models).count() == 2


def test_queries_have_the_contracts_columns(spark, folder):
    want = {
        "op11_byte_pairs": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op12_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
        "op13_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    }
    for name, columns in want.items():
        got = catalog.QUERIES[name](spark, folder)
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema) == columns
    rows = catalog.op11_byte_pairs(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    assert rows.where(F.col("decoded_sha256") != F.sha2(F.coalesce("text", F.lit("")), 256)).count() == 0


def test_url_rules_take_long_urls_in_proportion():
    rules = [("block", "a.org", "/x"), ("allow", "a.org", "/x" + "y" * 50), ("block", "org", "/"), ("allow", "a.org", "/x" + "y" * 50 + "/z"), ("block", "a.org", "")]
    (trie,) = url_rules.tries(rules, 10)
    start = time.perf_counter()
    for path in ("/x" + "y" * 1_000_000, "/" + "q" * 1_000_000, "/x" * 300_000, "/" * 300_000, "", "/x" + "y" * 49, "/x" + "y" * 50 + "/zz"):
        for host in ("a.org", "b.a.org", "c.org", "com"):
            fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
            want = max(fits, key=lambda r: len(r[1]) + len(r[2]), default=None)
            assert url_rules.best_rule(trie, host, path) == want
    assert time.perf_counter() - start < 20
