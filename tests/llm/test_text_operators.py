"""BPE, packing, PII and language-model scoring against brute force and round trips."""

import collections
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skriva.llm import bpe, lmscore, packing, pii
from skriva.llm.common import Scratch, table

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return packing.library_encoding(PATH, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aeinst 'r\n\t.,0é中²ſ", max_size=60))
def test_encodes_as_the_library(text):
    e = bpe.encoder(PATH, P.PATTERN)
    ids = list(e.encode(text))
    assert ids == packing.library_encoding(PATH, P.PATTERN).encode_ordinary(text)
    assert e.decode_bytes(ids) == text.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_both_rank_files(name):
    e, lib, rnd = bpe.encoder(P.path(name), P.PATTERN), packing.library_encoding(P.path(name), P.PATTERN), random.Random(5)
    for _ in range(300):
        s = "".join(rnd.choice("theanoirst ABC,.'sll\n  0189éß漢") for _ in range(rnd.randint(0, 80)))
        assert list(e.encode(s)) == lib.encode_ordinary(s)


def test_long_piece_is_linear(encoder, library):
    text = "ab" * 30_000
    assert list(encoder.encode(text)) == library.encode_ordinary(text)


def test_appends_and_edits(encoder, library):
    rnd = random.Random(2)
    for _ in range(60):
        x = bpe.EditableText(encoder, "".join(rnd.choice("ab 's1.\né ") for _ in range(rnd.randint(0, 60))))
        for _ in range(6):
            a = rnd.randint(0, len(x.text))
            x.replace(a, rnd.randint(a, min(len(x.text), a + 5)), "".join(rnd.choice("ab 's1.\n") for _ in range(rnd.randint(0, 6))))
            assert x.tokens() == library.encode_ordinary(x.text)
        x.append(" more'll")
        assert x.tokens() == library.encode_ordinary(x.text)


def test_edit_touches_only_its_surroundings(encoder):
    x = bpe.EditableText(encoder, "the cat sat on the mat " * 500)
    x.replace(4, 7, "dog")
    assert x.touched <= 3


def test_prefix_table_grows(encoder):
    t = bpe.PrefixTable(encoder.vocabulary, b"unbeliev")
    before = list(t.last)
    t.append(b"ably")
    assert list(t.last)[: len(before)] == before


def test_encode_decode_columns(spark, folder):
    docs = table(spark, folder([(1, "héllo wörld", "en", "a"), (2, None, "en", "a")]), "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert {r.doc_id: r.decoded for r in out} == {1: "héllo wörld", 2: ""}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(1, n), max_size=60))))
def test_best_fit_decreasing(case):
    length, sizes = case
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        room = [b for b in bins if b >= s]
        if room:
            bins[bins.index(min(room))] -= s
        else:
            bins.append(length - s)
    packs = packing.best_fit_decreasing(sizes, length)
    assert sorted(i for p in packs for i in p) == list(range(len(sizes)))
    assert sorted(length - sum(sizes[i] for i in p) for p in packs) == sorted(bins)


def test_packing_is_lossless(spark, folder, library):
    texts = {i: f"text number {i} " * (i % 50) for i in range(80)} | {80: "long " * 5000, 81: None, 82: ""}
    d = folder([(i, t, "en", "a") for i, t in texts.items()])
    rows = packing.pack(table(spark, d, "documents"), PATH, P.PATTERN, end=50256, pad=50256, length=128, pool=3000).collect()
    m, got = packing.matrix(rows), collections.defaultdict(list)
    for ids, r in zip(m, rows, strict=True):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used <= 128 and list(r.resets) == list(r.cu_seqlens[:-1])
        assert (ids[r.used :] == 50256).all() and packing.positions(r.cu_seqlens, 128)[0] == 0
        for a, b, doc, at in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.offsets, strict=False):
            got[doc].append((at, ids[a:b].tolist()))
    for i, t in texts.items():
        assert [x for _, part in sorted(got.get(i, [])) for x in part] == (library.encode_ordinary(t) + [50256] if t else [])


CASES = ["4111 1111 1111 1111", "2023-02-28", "1999/12/31", "28-02-2023", "31.12.1999", "12/31/1999", "DE89 3704 0044 0532 0130 00", "123-45-6789", "+49 170 555 1234", "+1 (017) 555-7713", "97.51.17.173",
         "und.34@mail7.example.com", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', 'API_KEY: "sk-ABCdef1234567890ABCD"', "ÉTÉ.1@example.org"]


@pytest.mark.parametrize("value", CASES)
def test_pseudonyms_keep_their_format_and_can_be_undone(value):
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    text = f"before {value} after"
    found = pii.finds(text, there)
    new = pii.replaced(text, found)
    assert len(found) == 1 and new != text and len(new) == len(text)
    assert [c.isdigit() for c in new] == [c.isdigit() for c in text] or "token" in text
    assert pii.replaced(new, pii.finds(new, back)) == text
    other = pii.Pseudonyms(b"other")
    assert pii.replaced(text, pii.finds(text, other)) != new


def test_pseudonyms_link_and_validate():
    p = pii.Pseudonyms(b"k")
    one = lambda v: pii.finds(v, p)[0][3]
    assert one("4111111111111111") == one("4111 1111 1111 1111").replace(" ", "")
    assert pii.luhn(one("4111111111111111")) and one("2023-02-28")[:4] == one("28.02.2023")[-4:]
    assert one("AB.1@x.org".lower()).upper() == one("AB.1@X.ORG")
    for clean in ("10.0.0.256", "2023-02-30", "999-45-6789", "version 2.0.", "chapter 12 of 15", "12:30", "1,000,000", "a@b", "CC BY-NC 4.0", "9807915762804490", "9807 9157 6280 4490"):
        assert not pii.finds(clean, p), clean


CARD, IBAN = "4111111111111111", "DE89370400440532013000"
ROWS_OF_NUMBERS = {
    "7536784127813050 4845168114407329": ["7536784127813050", "4845168114407329"], f"{CARD} {CARD}": [CARD, CARD], f"{CARD}-123": [CARD], f"7 {CARD}": [CARD],
    "4111 1111 1111 1111 5500 0000 0000 0004": ["4111 1111 1111 1111", "5500 0000 0000 0004"], "2023 4111 1111 1111 1111": ["4111 1111 1111 1111"],
    f"{CARD} 2023-02-28": [CARD, "2023-02-28"], "4111-1111-1111-1111 2023-02-28 7": ["4111-1111-1111-1111", "2023-02-28"], f"{'1' * 20} {CARD}": [CARD],
    f"{IBAN} 2023": [IBAN], "DE89 3704 0044 0532 0130 00 BIC COBADEFF": ["DE89 3704 0044 0532 0130 00"], f"{IBAN} {IBAN}": [IBAN, IBAN],
    f"{IBAN} {CARD} {CARD}": [IBAN, CARD, CARD], f"NR12 {CARD} ABCDEF": [CARD], "AB12 CDEF GHIJ KLMN OPQR": [], "1 2 3 4 5 6 7 8 9": []}


@pytest.mark.parametrize("text", ROWS_OF_NUMBERS)
def test_numbers_in_a_row_are_all_found(text):
    p = pii.Pseudonyms(b"k")
    found = pii.finds(f"x {text} y", p)
    assert [f"x {text} y"[a:b] for a, b, _, _ in found] == ROWS_OF_NUMBERS[text]
    for a, b, kind, new in found:
        alone = f"x {text} y"[a:b]
        assert [(kind, new)] == [x[2:] for x in pii.finds(alone, p)] and new != alone


LENGTHS = [*range(1, 60), 63, 64, 65, 100, 141, 257, 400, 1000, 1600, 3100, 3200, 4300, 4301, 10_000, 20_000]


@pytest.mark.parametrize("kind", ["local", "secret", "hex"])
def test_values_of_every_length_change_as_a_whole(kind):
    there, back, rnd = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True), random.Random(kind)
    letters = "0123456789abcdef" if kind == "hex" else "abcdefghijklmnopqrstuvwxyz"
    kept = total = 0
    for n in LENGTHS:
        value = "".join(rnd.choices(letters, k=n))
        text = f"to {value}@example.com" if kind == "local" else f"token = {value}"
        found = pii.finds(text, there)
        if kind != "local" and n < 16:
            assert not found
            continue
        new = pii.replaced(text, found)
        at = text.index(value)
        assert [(a, b) for a, b, _, _ in found] == [(at, at + n)] and len(new) == len(text)
        assert pii.replaced(new, pii.finds(new, back)) == text
        same = [x == y for x, y in zip(new[at : at + n], value, strict=True)]
        if n >= 400:  # the first and the last part change like the rest
            for part in (same[:100], same[-100:], same):
                assert sum(part) / len(part) < 3 / len(letters) + 0.02
        kept, total = kept + sum(same), total + n
    assert abs(kept / total - 1 / len(letters)) < 0.01


@settings(max_examples=150, deadline=None)
@given(st.text("abyzABYZ0189éÉßẞαΣςяЯ中한.%_", min_size=1, max_size=70))
def test_local_parts_of_any_script_come_back(local):
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    new = there.email(local)
    assert len(new) == len(local) and back.email(new) == local and [c.isupper() for c in new] == [c.isupper() for c in local]


def test_long_secrets_take_linear_time():
    p, value = pii.Pseudonyms(b"k"), "Zz9" * 300_000
    new = pii.replaced(f"key: {value}", pii.finds(f"key: {value}", p))
    assert len(new) == 5 + len(value) and sum(a == b for a, b in zip(new[5:], value, strict=True)) < 0.1 * len(value)


MASKS = {"999-99-9999": "ssn", "9999-99-99": "date", "9999/99/99": "date", "9999.99.99": "date", "99-99-9999": "date", "99/99/9999": "date", "99.99.9999": "date",
         "+9 (999) 999-9999": "phone", "+99 999 999 9999": "phone", "(999) 999-9999": "phone", "999-999-9999": "phone", "9999 9999 9999 9999": "card", "9999-9999-9999-9999": "card"}
MASKS |= {"9" * n: "card" for n in range(12, 20)}


def brute_finds(text):
    """(start, end, kind), by comparing every place of the text with every written form."""
    import calendar

    shape, out, at = "".join("9" if c in "0123456789" else c for c in text), [], 0
    digit = lambda i: 0 <= i < len(text) and text[i] in "0123456789"
    while at < len(text):
        best = None
        for mask, kind in MASKS.items():
            end = at + len(mask)
            if not shape.startswith(mask, at) or digit(end) or digit(at - 1):
                continue
            d = [int(c) for c in text[at:end] if c in "0123456789"]
            if kind == "card":
                total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
                if total % 10:
                    continue
            elif text[at - 1 : at] in ("-", ".", "/") and at:
                continue
            elif kind == "ssn":
                area, group, serial = int("".join(map(str, d[:3]))), d[3] * 10 + d[4], sum(d[5:])
                if area in (0, 666) or area >= 900 or not group or not serial:
                    continue
            elif kind == "date":
                n = int("".join(map(str, d)))
                tries = [(n // 10000, n // 100 % 100, n % 100)] if mask[4] in "-/." else [(n % 10000, n // 10000 % 100, n // 1000000), (n % 10000, n // 1000000, n // 10000 % 100)]
                if not any(1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= day <= calendar.monthrange(y, m)[1] for y, m, day in tries):
                    continue
            elif kind == "phone" and at and (text[at - 1].isalnum() or text[at - 1] in "_+"):
                continue
            if best is None or end > best[1]:
                best = (at, end, kind)
        if best is None and digit(at) and not digit(at - 1) and text[at - 1 : at] != ".":
            end = at
            while end < len(text) and (digit(end) or (text[end] == "." and digit(end + 1))):
                end += 1
            parts = text[at:end].split(".")
            if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 and str(int(p)) == p for p in parts):
                best = (at, end, "ip")
        if best:
            out.append(best)
            at = best[1]
        else:
            at += 1
    for i, word in ((i, w) for i, w in enumerate(text) if w == "@"):
        start = i
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        domain = text[i + 1 :].split()[0] if text[i + 1 : i + 2].strip() else ""
        if start < i and "." in domain.strip(".,;:!?\"')") and domain[0].isalnum():
            out = [x for x in out if not (start <= x[0] < i)] + [(start, i, "email")]
    for name in ("token = \"", "secret = \"", "password = \"", "api_key = \"", "key = \""):
        for i in range(len(text)):
            if text.startswith(name, i) and '"' in text[i + len(name) :]:
                end = text.index('"', i + len(name))
                if end - i - len(name) >= 16 and (i + len(name), end, "secret") not in out:
                    out = [x for x in out if not (i + len(name) <= x[0] < end)] + [(i + len(name), end, "secret")]
    return sorted(out)


def test_finds_of_a_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in pii.op4_pii_pseudonyms(spark, sf).collect()}
    want = {i: brute_finds(t or "") for i, t in texts.items()}
    assert {i: [(x.start, x.end, x.kind) for x in r.finds] for i, r in got.items()} == want and sum(map(len, want.values())) > 5
    for i, r in got.items():
        at = 0
        for a, b, _ in [*want[i], (len(texts[i] or ""), None, None)]:
            assert (r.text or "")[at:a] == (texts[i] or "")[at:a]
            at = b


def test_spans_replace_a_column_of_their_name(spark, folder):
    d = table(spark, folder([(1, "card 4111111111111111", "en", "a"), (2, None, "en", "a")]), "documents")
    out = pii.pseudonymise(d, b"k", spans="hits")
    assert out.columns.count("hits") == 1 and {r.doc_id: len(r.hits) for r in out.collect()} == {1: 1, 2: 0}


@pytest.mark.parametrize("n", [1, 2, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k", "t", n)
    assert sorted(map(f.forward, range(n))) == list(range(n)) and all(f.backward(f.forward(x)) == x for x in range(n))


def test_scores_against_plain_counting(spark, folder):
    rnd = random.Random(4)
    good, bad = [f"w{i}" for i in range(30)], [f"x{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choices(good if i % 3 else bad, k=20 + i)), "en", "a") for i in range(40)] + [(40, None, "en", "a"), (41, "W1", "en", "a")]
    d = folder(docs, labels=[(i, int(i % 3 > 0), 0) for i in range(0, 40, 2)])
    marked = {i for i in range(0, 40, 2) if i % 3}
    out = {r.doc_id: r for r in lmscore.score(table(spark, d, "documents"), spark.createDataFrame([(i,) for i in marked], "doc_id long"), Scratch(spark, "t")).collect()}
    words = {i: lmscore.word_ids(t).tolist() for i, t, _, _ in docs}
    cells = {i: lmscore.pair_cells(np.array(w, np.uint32)).tolist() for i, w in words.items()}

    def loss(i, among):
        rest = [j for j in among if j != i]
        c1 = collections.Counter(w for j in rest for w in words[j])
        c2 = collections.Counter(c for j in rest for c in cells[j])
        total, s = sum(c1.values()), 0.0
        for n, (w, c) in enumerate(zip(words[i], cells[i], strict=True)):
            p1 = (c1[w] + lmscore.UNIGRAM_PRIOR) / (total + lmscore.UNIGRAM_PRIOR * lmscore.WORDS)
            left = c1[words[i][n - 1]] if n else c2[c]
            s -= math.log((min(c2[c], left) + lmscore.BIGRAM_PRIOR * p1) / (left + lmscore.BIGRAM_PRIOR))
        return s / len(words[i])

    for i, t, _, _ in docs:
        if t is None:
            assert out[i].n_words == 0 and out[i].score is None
        else:
            assert out[i].loss_target == pytest.approx(loss(i, marked), rel=1e-5) and out[i].loss_background == pytest.approx(loss(i, words), rel=1e-5)
    assert max(out[i].score for i in range(40) if i % 3) < min(out[i].score for i in range(0, 40, 3))


def test_scores_keep_words_apart_that_share_high_hash_bits(spark, folder):
    import xxhash

    met = {}
    for i in range(5000):  # two words with the same 18 high bits
        w = f"w{i}"
        other = met.setdefault(xxhash.xxh3_64_intdigest(w.encode()) >> 46, w)
        if other != w:
            break
    docs = [(0, f"{other} {other} a", "en", "a"), (1, f"{other} b", "en", "a"), (2, f"{w} c", "en", "a"), (3, "d", "en", "a"), (4, None, "en", "a")]
    d = table(spark, folder(docs), "documents").repartition(2)
    target = spark.createDataFrame([(0,)], "doc_id long")
    found = [{r.doc_id: r for r in lmscore.score(d, target, Scratch(spark, "t"), size).collect()} for size in (1, 1000)]
    prior, n = lmscore.UNIGRAM_PRIOR, lmscore.WORDS
    for out in found:  # in chunks of one document as in one chunk
        # Neither word of document 2 occurs in the target (3 words), while document 1's first one does.
        assert out[2].loss_target == pytest.approx(-math.log(prior / (3 + prior * n)))
        assert out[1].loss_target < out[2].loss_target and out[4].n_words == 0 and out[4].score is None
        assert all(out[i].loss_background == pytest.approx(found[0][i].loss_background) for i in range(4))
