"""Collocations, alignment of two tokenizers and removal of repeats against brute force and known cases."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import LOWER, documents, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterforge.llm import alignment, collocations, repeats

ODD = (None, "", " ", "  a ", "x" * 20_000, "w " * 20_000, "é漢▁z", "a\n  b\tc ", "<s> <|endoftext|> <0x41>", "\x00\x1c\x85 !")


def plain_phrases(rows, longest, least, most, share):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, (text or "").translate(LOWER)
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    wanted = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in wanted.items():
        cuts = [(a * a * 1_000_000 // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(z == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (z, v), b in wanted.items())
        if not inside:
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked, seen = [], Counter()
    for lang, phrase, a, left, right, total, score in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        seen[lang] += 1
        if seen[lang] <= most:
            ranked.append((lang, seen[lang], phrase, a, left, right, total, score))
    return ranked


@pytest.mark.parametrize(("longest", "least", "most", "block"), [(3, 10, 2000, 8 << 20), (4, 2, 7, 60), (2, 1, 2000, 1)])
def test_phrases(spark, monkeypatch, longest, least, most, block):
    rnd = random.Random(7)
    words = ["The", "of", "cat", "É", "a b", "x" * 300]
    rows = [(rnd.choice(["en", None, "und"]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(rnd.randrange(40)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, " \t"), ("de", "the end. of")]
    docs = spark.createDataFrame([(k, t, lang, 1, "w") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, local int, word string").repartition(3)
    monkeypatch.setattr(collocations, "IN_BUCKET", 50)
    got = collocations.collocations(docs, longest=longest, least=least, most=most, block=block)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, longest, least, most, 50)


def test_phrases_of_no_rows_and_exact_scores(spark):
    assert collocations.collocations(documents(spark, (1, None)).limit(0)).count() == 0
    a, left, right = 3_037_000_501, 4_000_000_007, 9_223_372_036  # a * a passes 64 bits
    level = spark.createDataFrame([(1, "en", "x y", [left, a], [a, right])], "name long, lang string, phrase string, before array<long>, after array<long>")
    row = collocations.scored(level, 2).first()
    assert (row.score, row.l, row.r) == (Fraction(a * a * 1_000_000, left * right).__floor__(), left, right)


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each text by the libraries, byte offsets and all pairs."""
    a_lib, b_lib = Tokenizer.from_file(public_tokenizers.path(alignment.BYTES)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    a_lib.encode_special_tokens = True
    of = alignment.byte_characters()
    spell_a = lambda i: bytes(of[c] for c in a_lib.id_to_token(i))
    spell_b = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()

    def placed(ids, spell):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(spell(i)), i))
            at += len(spell(i))
        return out

    made, counts = [], Counter()
    for t in texts:
        a = placed(a_lib.encode(" " + t, add_special_tokens=False).ids, spell_a) if t else []
        b = placed(b_lib.encode(t), spell_b) if t else []
        if b"".join(spell_a(i) for _, _, i in a) != f" {t}".encode() or b"".join(spell_b(i) for _, _, i in b) != f" {t}".encode():
            a = b = []
        links, k = [], 0
        for x in a:
            while k and b[k][0] > x[0]:
                k -= 1
            links += [(x[2], y[2]) for y in b[max(0, k - 40) : k + 200] if x[0] < y[1] and y[0] < x[1]]
            while k < len(b) - 1 and b[k][1] <= x[1]:
                k += 1
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, i, j = [], 0, 0
        for e in ends:
            g, h = i, j
            while i < len(a) and a[i][1] <= e:
                i += 1
            while j < len(b) and b[j][1] <= e:
                j += 1
            groups.append(",".join(str(x[2]) for x in a[g:i]) + "|" + ",".join(str(y[2]) for y in b[h:j]))
        made.append((len(a), len(b), groups, links))
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    said = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(a, b, len(g), len(links), said(g), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)) for a, b, g, links in made]


@pytest.mark.parametrize("block", [4 << 20, 500])
def test_alignment(spark, block):
    docs = {**table(spark), **{10_000 + k: t for k, t in enumerate(ODD)}, 20_000: "x y", 20_001: "x y"}
    want = dict(zip(docs, plain_alignment(list(docs.values())), strict=True))
    got, pairs = alignment.align(documents(spark, *docs.items()).repartition(3), block=block)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got.collect()} == want
    t = pairs.agg(F.sum("count"), F.count("*"), F.countDistinct("a", "b")).first()
    assert t[0] == sum(w[3] for w in want.values()) and t[1] == t[2]


def test_alignment_of_no_rows_and_repeated_rows(spark):
    assert alignment.align(documents(spark, (1, "a")).limit(0))[0].count() == 0
    got = alignment.align(documents(spark, (1, "a b"), (1, "a b"), (None, None)), with_groups=True)[0].collect()
    assert sorted((r.doc_id or 0, r.n_groups, r.groups.count(";")) for r in got) == [(0, 0, 0), (1, 2, 1), (1, 2, 1)]


@settings(max_examples=1000, deadline=None)
@given(st.text(st.sampled_from(list("abT  \n\té漢.,'1²\u0301")), max_size=40))
def test_stretches_are_encoded_like_whole_texts(text):
    own = alignment.aligner(public_tokenizers.path(alignment.BYTES), public_tokenizers.path(alignment.PIECES))
    parts = alignment.stretches(text) if text else []
    assert " ".join(parts).replace(f" {alignment.MARK}", "") == text
    if text:
        whole_a, whole_b = own.a.encode([f" {text}"])[0], own.b.encode([text])[0]
        assert [x for p in own.a.encode([p[1:] if p[:1] == alignment.MARK else f" {p}" for p in parts]) for x in p] == whole_a and [x for p in own.b.encode(parts) for x in p] == whole_b


def test_transducer_cuts_where_both_end():
    t = alignment.Transducer({1: b"ab", 2: b"c", 3: b"de"}, {1: b"a", 2: b"bcd", 3: b"e", 4: b"x"})
    assert t.align([1, 2, 3], [1, 2, 3]) == ([(3, 3)], [1 << 32 | 1, 1 << 32 | 2, 2 << 32 | 2, 3 << 32 | 2, 3 << 32 | 3])
    assert t.align([1], [1]) is None and t.align([1], [4]) is None and t.align([], [1]) is None and t.align([], []) == ([], [])
    assert t.step(0, b"bc", 1) is None and t.step(1, b"abc", 1) == (1, b"c")


def plain_repeats(rows, width):
    seen, texts = {}, [(t or "").encode() for _, t in rows]
    for k, b in enumerate(texts):
        for i in range(len(b) - width + 1):
            seen.setdefault(b[i : i + width], []).append((k, i))
    gone = [bytearray(len(b)) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + width] = b"\1" * width
    out = []
    for (d, _), b, g in zip(rows, texts, gone, strict=True):
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((d, len(b), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(b, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def result(docs, **options):
    return sorted((tuple(r)[:5] for r in repeats.remove_repeats(docs, **options).collect()), key=str)


def test_repeats_of_the_table(spark):
    rows = list(table(spark).items())
    assert result(documents(spark, *rows).repartition(3)) == plain_repeats(rows, 200)


@pytest.mark.parametrize("options", [{}, {"many": 3, "block": 3000, "bucket": 4000, "shard": 900}, {"many": 10**9, "bucket": 10**9, "shard": 700}])
def test_repeats_of_odd_rows(spark, options):
    """Also with passages of an anchor cut finer, and with shards merged."""
    rnd = random.Random(3)
    some = lambda of, n: "".join(rnd.choice(of) for _ in range(n))
    passage = some("abcdefgh ", 700)
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "y" * 200), (6, "z" * 201), (7, "ab" * 300), (7, "ab" * 300), (None, "é" * 900)]
    rows += [(100 + i, some("abcd ", rnd.randrange(300)) + passage[rnd.randrange(200) : rnd.randrange(400, 700)] + some("ab", rnd.randrange(300))) for i in range(40)]
    assert result(documents(spark, *rows), **options) == plain_repeats(rows, 200)


def test_repeats_give_spans_and_no_rows_of_an_empty_table(spark):
    assert repeats.remove_repeats(documents(spark, (1, "a")).limit(0)).count() == 0
    rnd = random.Random(1)
    a, b, c = ("".join(rnd.choice("abcdefghij") for _ in range(n)) for n in (250, 300, 150))
    got = {r.doc_id: r.spans for r in repeats.remove_repeats(documents(spark, (1, a + b + c), (2, c + b), (3, b[:200]))).collect()}
    assert got == {1: [250, 550], 2: [150, 450], 3: [0, 200]}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 9))
def test_suffix_arrays_and_common_prefixes(data, lanes):
    data = bytes(97 + x % 2 for x in data)
    order = repeats.suffix_array(np.frombuffer(data, np.uint8))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    common = repeats.common_prefixes(np.frombuffer(data, np.uint8), order, 30, lanes)
    for x, y in zip(order.tolist(), order.tolist()[1:], strict=False):
        h = 0
        while h < 30 and data[x + h : x + h + 1] == data[y + h : y + h + 1] != b"":
            h += 1
        assert common[y] == h


def test_anchors_of_equal_strings_are_equal():
    rnd = random.Random(5)
    shared = bytes(rnd.randrange(97, 100) for _ in range(500))
    texts = [bytes(rnd.randrange(97, 100) for _ in range(n)) + shared for n in (0, 77, 3000)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    anchor, first, last, _ = repeats.anchors(data, ends)
    owner = {s: x - s for x, a, z in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(a, z + 1)}
    for k in range(301):
        assert len({owner[int(e) - 500 + k] for e in ends}) == 1
    assert len(owner) == sum(len(t) - 199 for t in texts)
