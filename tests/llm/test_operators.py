"""Training-data operators against brute force, the libraries, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from archlight.llm import bpe, common, long_matches, near_dups, packing, page_blocks, page_labels, page_text, quality_rules, queries, sentence_spans, site_quality, telephony, token_counts

from ..conftest import duck, rows_of
from . import brute, foreign

SP = public_tokenizers.path("piece_bpe_32k.model")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i * 7919 % 9001}" for i in range(9000))
ODD = [None, "", " \n\t ", "one", "a b c d", "Ünïcödé　中文 <s> <|endoftext|> \x00\x1c 🤖", LONG, "same text here " * 30, "same text here " * 30]


def table(spark, rows, **extra):
    """Documents with ids from 0, the given texts and clashing extra columns."""
    data = [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("kept", "_kept", "n_words", "k1", "_k1", "_k2", "c", "h", "_once", "once", "copies", "piece", "row", "cleaned", "gone", "_host", "x")
    return df.withColumns({c: F.lit(1) for c in clashing} | extra)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [*enumerate(ODD), (None, "no id " * 60), (7, "same text here " * 30)])


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck(sf).sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_recent():
    made = []
    known = common.Recent(2, lambda k: made.append(k) or k * 2)
    assert [known[k] for k in (1, 2, 1, 3, 2, 1)] == [2, 4, 2, 6, 4, 2] and made == [1, 2, 3]  # 1 and 2 come back from the older generation
    store, asked = common.Twice(4, 4), []
    for keys in ({1, 2}, {1}, {1, 3}, {4, 5, 6}, {1, 2}, {2, 3}):
        assert store.resolve(keys, lambda new: asked.append(sorted(new)) or [k * 2 for k in new]) == {k: k * 2 for k in keys}
    assert asked == [[1, 2], [], [3], [4, 5, 6], [2], [3]] and 1 in store.kept


# 1


def test_quality_counts(spark, odd):
    rows = {r["doc_id"]: r for r in quality_rules.measure(odd).collect() if r["doc_id"] != 7}
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    assert rows[1]["n_dup_lines"] == 0 and rows[4]["word_chars"] == 4
    assert rows[6]["n_words"] == 9000 and rows[6]["kept"] and not rows[6]["base_failed"]
    assert rows[8]["n_repeat_words"] == 90 and rows[8]["base_failed"]
    assert quality_rules.measure(odd.limit(0)).count() == 0 and quality_rules.measure(odd).count() == odd.count()


def test_quality_lines(spark):
    good = "\n".join(" ".join(f"Word{i}x{k}" for k in range(11)) + "." for i in range(8))
    noisy = good + "\nHome | About | Contact | Help\nAll rights reserved.\nBUY!! NOW!! CHEAP!!\nx"
    junk = "\n".join(["BUY!! NOW!! CHEAP!! THINGS!! HERE!! AND!! MORE!!", "Home | News | Sport | Weather | Travel"] * 8) + " ".join(f"w{i}" for i in range(40))
    rows = {r["doc_id"]: r for r in quality_rules.measure(table(spark, [(0, good), (1, noisy), (2, junk)])).collect()}
    assert (rows[0]["kept"], rows[0]["lost_chars"], rows[1]["kept"], rows[2]["kept"]) == (True, 0, True, False)
    clean = {r["doc_id"]: r for r in quality_rules.clean_documents(table(spark, [(0, good), (1, noisy), (2, junk)])).collect()}
    assert clean[1]["text"] == good and clean[1]["n_chars"] == len(good) and set(clean) == {0, 1} and clean[0]["kept"] == 1


# 2


def told(rows, *columns):
    """Rows as a multiset of what is checked, so that null and repeated ids count as well."""
    return Counter(tuple(r[c] for c in columns) for r in rows)


def test_media(spark, odd):
    rows = telephony.read_media(telephony.store_bytes(odd), keep_pcm=True).collect()
    want, kinds = Counter(), set()
    for doc_id, text in odd.select("doc_id", "text").collect():
        raw = (text or "").encode()
        full = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        media = telephony.stored(full)
        kind, rate, align, data = telephony.parse(media)
        kinds.add(kind)
        if kind == telephony.ADPCM:
            own = adpcm_slow(data, align) if len(data) < 9000 else telephony.decode_adpcm(data, align)
        else:
            own = np.array([(telephony.MULAW_PCM if kind == telephony.MULAW else telephony.ALAW_PCM)[x] for x in full], np.int16)
        pcm = telephony.resample(own)
        assert np.array_equal(pcm[::2], own) and (rate, len(pcm)) == (8000, 2 * len(own))
        kept = telephony.wav(telephony.PCM, 16000, pcm.astype("<i2").tobytes(), 16, 2)
        want[doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), hashlib.sha256(media).hexdigest(), telephony.features(kind, 16000, pcm), kept] += 1
    assert kinds == set(telephony.FORMS)
    assert told([r.asDict() | {"pcm": bytes(r["pcm"])} for r in rows], "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm") == want
    broken = spark.createDataFrame([(1, 3, bytearray(b"RIFFxxxxWAVE")), (2, 3, None)], "doc_id long, n_bytes long, media binary")
    assert [r["feature"] for r in telephony.read_media(broken).collect()] == ["unreadable"] * 2
    assert telephony.read_media(telephony.store_bytes(odd.limit(0))).count() == 0


@pytest.mark.parametrize("kind", telephony.FORMS)
def test_media_forms(kind):
    draw = random.Random(kind)
    payload = draw.randbytes(64 * 9)
    media = telephony.stored(payload, kind)
    got, _, align, data = telephony.parse(media)
    assert got == kind and telephony.payload_in(kind, align, data) == payload
    if kind == telephony.ADPCM:
        both = telephony.expand_all([telephony.parse(media), None, telephony.parse(telephony.stored(payload[:64], kind))])
        assert np.array_equal(both[0], adpcm_slow(data, align)) and both[1] is None and np.array_equal(both[2], adpcm_slow(data[:68], align))


def test_companding():
    assert telephony.MULAW_PCM[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert sorted(set(telephony.ALAW_PCM.tolist())) == sorted(set((-telephony.ALAW_PCM.astype(int)).tolist()))
    x = (np.sin(np.arange(5000) / 9) * 9000).astype(np.int16)
    coded = telephony.encode_adpcm(x, 256)
    assert np.abs(telephony.decode_adpcm(coded, 256)[:5000].astype(int) - x).mean() < 150
    kind, _, align, data = telephony.parse(telephony.wav(telephony.ADPCM, 8000, coded, 4, 256, b"\xf9\x01"))
    assert np.array_equal(telephony.expand(kind, align, data), adpcm_slow(coded, 256))
    assert len(telephony.decode_adpcm(b"", 256)) == 0 and len(telephony.resample(np.zeros(0, np.int16))) == 0


@pytest.mark.parametrize("own", [8000, 11025, 22050, 44100, 48000])
def test_media_at_the_rate_asked(spark, own):
    tone = lambda rate: np.sin(2 * np.pi * 440 * np.arange(rate // 2) / rate) * 9000
    media = telephony.wav(telephony.PCM, own, np.rint(tone(own)).astype("<i2").tobytes(), 16, 2)
    rows = spark.createDataFrame([(1, 1, bytearray(media))], "doc_id long, n_bytes long, media binary")
    r = telephony.read_media(rows, keep_pcm=True).first()
    _, rate, _, data = telephony.parse(r["pcm"])
    pcm, want = np.frombuffer(data, "<i2"), tone(16_000)
    assert rate == 16_000 and "rate=16000;samples=8000;" in r["feature"] and len(pcm) == 8000
    assert np.abs(pcm - want)[100:-100].max() < 90
    high = np.rint(np.sin(2 * np.pi * 11_000 * np.arange(4410) / 44_100) * 9000).astype(np.int16)
    assert np.abs(telephony.convert(high, 44_100, 16_000)[50:-50]).max() < 900  # above the new band


def test_media_query_stores_pcm(spark, sf):
    assert "pcm" in queries.QUERIES["op2_media_columns"](spark, sf).columns


def adpcm_slow(data, align):
    """One sample after another."""
    out = []
    for at in range(0, len(data), align):
        block = data[at : at + align]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code & 7])))
                out.append(value)
    return np.array(out, np.int16)


# 3


def test_spans(spark):
    shared = "The first shared sentence is here. The second one follows it closely. And the third ends the passage well. "
    one = "Own opening words of one. " + shared + "Own ending words of one."
    two = "Other opening words of two.\n" + shared + "Other ending words."
    rows = [(5, two), (3, one), (9, shared + shared), (10, None), (11, ""), (12, "A. B. C. D. E."), (13, "A. B. C. D. E."), (14, one), (None, "nothing shared at all in this one")]
    got = {r["doc_id"]: r for r in sentence_spans.report(table(spark, rows)).collect()}
    assert got[3]["n_removed"] == 0 and got[3]["text"] == one  # the smallest id is first
    assert got[5]["text"] == "Other opening words of two.\nOther ending words." and got[5]["n_removed"] == 3
    assert got[9]["text"] == "" and got[14]["text"] == ""
    assert got[10]["text"] is None and got[11]["text"] == "" and got[None]["n_removed"] == 0
    assert got[12]["n_removed"] == 0 and got[13]["text"] == ""  # short sentences are a run as well
    inside = {r["doc_id"]: r for r in sentence_spans.report(table(spark, [(1, shared + "Between. " + shared)])).collect()}
    assert inside[1]["text"] == shared + "Between. "
    assert sentence_spans.report(table(spark, rows).limit(0)).count() == 0
    left = sentence_spans.remove(table(spark, rows))
    assert left.columns == table(spark, rows).columns and {r["doc_id"]: r["n_chars"] for r in left.collect()}[5] == len("Other opening words of two.\nOther ending words.")


def test_short_runs_and_null_ids(spark):
    """Three sentences of 9 and of 12 words are a run; -1 and a null id are two documents."""
    nine, twelve = "Accept all cookies. Close this banner. Read our policy. ", "The cookie settings page opened. Please accept all of them. Thank you for reading. "
    for shared in (nine, twelve):
        rows = [(k, f"Opening number {k * 7919} of this text here. {shared}Ending number {k * 104729} comes after that.") for k in range(4)]
        got = {r["doc_id"]: r["text"] for r in sentence_spans.report(table(spark, rows)).collect()}
        assert shared in got[0] and not any(shared in got[k] for k in (1, 2, 3))
    text = " ".join(f"Sentence {k} of the text has words {k * 31}." for k in range(9))
    got = {r["doc_id"]: r["n_removed"] for r in sentence_spans.report(table(spark, [(-1, text), (None, text)])).collect()}
    assert got == {None: 0, -1: len(sentence_spans.Pieces(text.encode()).cuts) - 1}


def span_rows(seed):
    """Texts of few words and sentences, so that runs repeat; null and repeated ids, repeated rows."""
    draw = random.Random(seed)
    said = [" ".join(draw.choice("ab cd ef gh ij kl mn op qr st é".split()) for _ in range(draw.choice((1, 2, 4, 9, 20, 40)))) for _ in range(14)]
    text = lambda: draw.choice(("", " ", "\n\n")) + "".join(draw.choice(said) + draw.choice((". ", ". ", "!\n", "\n", " ", "?  ")) for _ in range(draw.randint(0, 9)))
    rows = [(draw.choice((None, *range(12))), draw.choice((None, "", text(), text(), text()))) for _ in range(40)]
    return rows + draw.sample(rows, 6)


@pytest.mark.parametrize("seed, part", [(1, 400_000), (2, 5), (3, 60)])
def test_spans_against_brute_force(spark, monkeypatch, seed, part, tmp_path):
    monkeypatch.setattr(sentence_spans, "PART", part)
    rows = span_rows(seed)
    want = brute.spans(rows)
    got = sorted(((r["doc_id"], r["n_removed"], r["text"]) for r in sentence_spans.report(table(spark, rows)).collect()), key=repr)
    assert got == want and sum(r[1] for r in want) > 20
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    twin = duck(str(tmp_path)).sql(sentence_spans.ORACLE).fetchall()
    assert sorted(((r[0], r[1], r[3]) for r in twin), key=repr) == want


def test_passages_at_any_offset(spark):
    """51 words are found wherever they begin in a sentence, but for a few at their edges."""
    rnd = random.Random(3)
    own = lambda n: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))
    found = [own(400), *(own(51) for _ in range(20)), *(f"{own(24)}. {own(23)}. {own(24)}" for _ in range(5))]
    rows = [(len(found) * k + i, f"{own(before)} {p} {own(before)}.".strip()) for k, before in enumerate((3, 2, 0, 17, 40)) for i, p in enumerate(found)]
    edges = 4 * (sentence_spans.WINDOW - 1)
    got = {r["doc_id"]: r for r in sentence_spans.report(table(spark, rows)).collect()}
    for i, text in rows:
        p = found[i % len(found)]
        if i < len(found):
            assert got[i]["text"] == text and got[i]["removed_chars"] == 0
        else:
            assert sum(w in set(p.split()) for w in got[i]["text"].split()) <= edges
            assert [w for w in text.split() if w not in p] == [w for w in got[i]["text"].split() if w not in p]


def test_spans_of_a_very_long_text(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    got = {r["doc_id"]: r for r in sentence_spans.report(table(spark, [(1, long), (2, "x " + long), (3, "short text")])).collect()}
    assert got[1]["n_removed"] == 0 and len(got[2]["text"]) < 200 and got[3]["text"] == "short text"


# 4


def test_pages_held_out():
    chain, right, total = page_text.trained(), 0, 0
    for page, truth in page_labels.labelled_pages(150, seed=4242):
        found, labels = page_text.align(page, truth)
        assert len(found) == len(truth)
        decoded = chain.decode(found)
        right, total = right + sum(a == b for a, b in zip(labels, decoded)), total + len(labels)
    assert right / total > 0.96


def test_viterbi():
    chain = page_text.Chain({"a": 1.3, "b": -0.4, "c": -2.0}, [[0.5, -0.7], [-0.3, 0.6]])
    draw = random.Random(1)
    for _ in range(60):
        found = [page_blocks.Block("x", frozenset(), frozenset(), 0, [draw.choice("abc")]) for _ in range(draw.randint(1, 7))]
        score = lambda labels: sum(chain.weights[b.features[0]] * x for b, x in zip(found, labels)) + sum(chain.turn[x][y] for x, y in zip(labels, labels[1:]))  # noqa: E731, B023
        best = max(score([k >> i & 1 for i in range(len(found))]) for k in range(2 ** len(found)))
        assert abs(score(list(map(int, chain.decode(found)))) - best) < 1e-9


def test_pages(spark):
    body = "<p>" + "A long and quiet paragraph of the article follows here, with many words. " * 3 + "</p>"
    page = f"<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class=ad>Buy this now</div><article><h1>Title &amp; more</h1>{body}<p>Second&nbsp;one \n ends <b>here</b>.</p></article><section class=comments><p>I like it.</p></section><footer>&copy; all</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (4, "w", "<p>a<b>c</p><"), (5, "x", "no markup")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r for r in page_text.extract(rows).collect()}
    want = "Title & more " + ("A long and quiet paragraph of the article follows here, with many words. " * 3).strip() + " Second one ends here."
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == "" and got[None]["text"] == "" and len(got) == 5
    assert page_text.extract(rows.limit(0)).count() == 0
    assert [b.text for b in page_blocks.blocks("<DIV>a<p>b<p>c</div>d<!-- x --><style>p{}</style>e<br>f")] == ["a", "b", "c", "d", "e f"]


def test_pages_of_other_hands():
    """Word precision and recall on pages that no generator of ours made."""
    chain = page_text.trained()
    for page, want in foreign.PAGES:
        got, want = Counter(page_text.main_text(page, chain)[0].split()), Counter(want.split())
        both = (got & want).total()
        assert both >= 0.95 * got.total() and both >= 0.95 * want.total()


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250_000, '<a ">"' * 150_000, "<div>x" * 150_000, "<h1>x" * 170_000, "<b>" + "<div>" * 80_000 + "</b>" * 150_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 150_000, "<!" * 500_000, "<li>x<td>y" * 100_000, "<head>" * 100_000 + "<body>" * 100_000, "x " * 500_000],
    ids=lambda p: p[:12],
)
def test_pages_in_linear_time(page):
    began = time.process_time()
    page_text.main_text(page, page_text.Chain({}, [[0.0, 0.0], [0.0, 0.0]]))
    assert time.process_time() - began < 8


def test_pages_tied_and_repeated(spark):
    long = "<p>" + "A very long paragraph of one article goes on and on here. " * 20_000 + "</p>"
    rows = spark.createDataFrame([(1, "u", f"<article>{long}</article>"), (1, "u", f"<article>{long}</article>"), (None, None, "<p>x</p>")], "page_id long, url string, html string")
    got = page_text.extract(rows).collect()
    assert len(got) == 3 and len({r["text"] for r in got if r["page_id"] == 1}) == 1
    assert next(r["n_chars"] for r in got if r["page_id"] == 1) == len(long) - 8


# 5


def test_token_counts(spark, odd, texts):
    model = token_counts.load(SP)
    rows = [r for r in token_counts.count_tokens(odd, SP, limit=100, chunk=700, overlap=20).collect()]
    assert len(rows) == odd.count()
    given = [(r[0], r[1] or "") for r in odd.select("doc_id", "text").collect()]
    assert told(rows, "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter((i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 100) for i, t in given)
    assert token_counts.count_tokens(odd.limit(0), SP).count() == 0
    assert max(r["n_chunks"] for r in rows) > 10
    draw = random.Random(2)
    for k in range(400):
        s = "".join(draw.choice("ab  ▁\n\t\ré中x<0>") for _ in range(draw.randint(0, 200))) if k % 2 else draw.choice(texts)[1][: draw.randint(1, 900)]
        for alone in (frozenset(), token_counts.lone(SP)):
            assert token_counts.count_spliced(model, s, draw.randint(5, 90), draw.randint(1, 20), alone)[0] == len(model.encode(s))
    assert token_counts.lone(SP) == {"\n", "\t"}
    bare = "\n".join(f"line\tno{i}" for i in range(20_000))
    count, chunks, widened = token_counts.count_spliced(model, bare, alone=token_counts.lone(SP))
    assert count == len(model.encode(bare)) and chunks > 6 and widened == 0


# 6


def test_bpe(spark, odd, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    draw = random.Random(3)
    parts = ["a", "aa", " ", "  ", "\n", "é", "中", "<|endoftext|>", "'s", "12", "\x1c", "\x85", "　", "!?", "🤖", "\x00", "\r\n"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(1500)] + [t for _, t in texts[:60]]
    vocabulary = bpe.Vocabulary(BYTE)
    for s, ids in zip(made, vocabulary.encode_batch(made)):
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids and vocabulary.decode(ids) == s
    rows = bpe.encode_decode(odd, BYTE, keep_ids=True).collect()
    assert len(rows) == odd.count()
    want = Counter()
    for i, t in ((r[0], r[1] or "") for r in odd.select("doc_id", "text").collect()):
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert told(rows, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_decode(odd.limit(0), BYTE).count() == 0


def test_bpe_blocks():
    """A batch is encoded in slices of bounded bytes; a longer row stands alone."""
    rows = ["é" * 300_000, None, "a" * 500_000, "", "b" * 3_000_000, "c" * 10] * 5
    whole = bpe.pa.RecordBatch.from_arrays([bpe.pa.array(range(30)), bpe.pa.array(rows)], names=["doc_id", "text"])
    for b in (whole, whole.slice(1)):
        got = list(bpe.blocks(b))
        assert [r for x in got for r in x.to_pylist()] == b.to_pylist()
        sizes = [[len((t or "").encode()) for t in x.column(1).to_pylist()] for x in got]
        assert all(sum(s) <= bpe.BLOCK or len(s) == 1 for s in sizes) and len(sizes) >= 10
    assert list(bpe.blocks(whole.slice(0, 0))) == []


# 7


def near_rows():
    draw = random.Random(5)
    rows, n = [], 0
    for g in range(6):
        base = [f"w{g}x{draw.randint(0, 900)}" for _ in range(120)]
        for k in range(draw.randint(1, 14)):
            w = list(base)
            for _ in range(draw.randint(0, 5)):
                w[draw.randrange(len(w))] = f"n{draw.randint(0, 10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(n + i, f"{passage} " + " ".join(f"q{draw.randint(0, 10**6)}" for _ in range(90))) for i in range(25)]
    n += 25
    extra = [None, "", " ", "a b", "A  b", "b a", "a b c d e", "A B C D E\n", rows[3][1].upper(), rows[3][1]]
    return rows + [(n + i, t) for i, t in enumerate(extra)]


@pytest.mark.parametrize("size", [1024, 5])
def test_near_dups(spark, monkeypatch, size):
    monkeypatch.setattr(near_dups, "LIST", size)
    rows = near_rows()
    want = brute.components(rows)
    got = near_dups.report(table(spark, [*rows, (None, rows[0][1]), rows[0]])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])
    if size == 5:
        left = near_dups.keep(table(spark, [*rows, (None, rows[0][1]), rows[0]]))
        assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_dups_tables(spark, docs, texts):
    want = brute.components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.report(docs).collect()} == want
    assert near_dups.report(docs.limit(0)).count() == 0
    assert near_dups.report(table(spark, [(1, "only one text here and no other")])).first()["kept"]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dups_across_tiles(spark, monkeypatch, percent):
    """Near copies of one text around the threshold: many components in the same lists, cut into many tiles."""
    monkeypatch.setattr(near_dups, "LIST", 16)
    monkeypatch.setattr(near_dups, "WEIGHT", 4000)
    draw, rows = random.Random(11), []
    base = [f"w{i}" for i in range(300)]
    for i in range(150):
        w = list(base)
        for k in draw.sample(range(300), draw.choice((2, 4, 5, 6, 7))):
            w[k] = f"x{draw.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    want = brute.components(rows, percent)
    assert len({c for _, c in want.values()}) > 1
    assert {r["doc_id"]: (r["n"], r["component"]) for r in near_dups.link(table(spark, rows), percent).collect()} == want


def test_near_dups_of_shared_ids(spark, monkeypatch):
    """Ids with several texts, each in a class of its own or of another id, are one node; every class gets its set once."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(4, text("a")), (4, text("b")), (2, text("b") + " more"), (7, text("a")), (9, text("c")), (9, ""), (3, text("c")), (5, text("d")), (5, text("d")), (6, text("D") + " x"), (8, ""), (8, "")]
    rows += [(50, text(f"e{k}")) for k in range(12)] + [(60, text("e3") + " end"), (40, text("e8"))]
    want = {i: c for i, (_, c) in brute.components(rows).items()}
    assert want[4] == want[7] == 2 and want[9] == 3 and want[60] == want[50] == 40
    met, made = near_dups.first_pairs, []

    def first_pairs(listed, percent):
        made.append((listed.count(), listed.select("h", "part", "c").distinct().count()))
        return met(listed, percent)

    monkeypatch.setattr(near_dups, "first_pairs", first_pairs)
    got = near_dups.link(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["component"] == want[r["doc_id"]] for r in got)
    assert made[0][0] == made[0][1]  # a posting once, however many texts its id has


def test_near_dups_tiles_are_bounded():
    """2,000 documents all a little under the threshold of each other, and then all above it: links are a forest at most."""
    draw = np.random.default_rng(4)
    common = draw.integers(0, 2**62, 270, dtype=np.uint64)
    sets = [np.unique(np.concatenate((common, draw.integers(0, 2**62, 30, dtype=np.uint64)))) for _ in range(2000)]
    assert near_dups.unions(sets, np.arange(2000), 85) == []  # 270 of 330
    links = near_dups.unions(sets, np.arange(2000), 80)
    assert len(links) == 1999 and len(near_dups.unions(sets, np.arange(2000) // 1000, 80)) == 1
    posted = [near_dups.minima(s) for s in sets[:300]]
    sig = np.stack([near_dups.signature(s, k) for s, k in zip(sets, posted)])
    exact = (sig == sig[0]).sum(axis=1)
    assert np.array_equal(near_dups.collisions(sig, sig[0], 396), np.where(exact >= 396, exact, 0))
    assert len(near_dups.forest(sig, 300)) == 299


# 8


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    got = packing.pack_documents(odd, WORD, capacity=64, group=10).collect()
    by_bin, want = {}, Counter()
    for r in got:
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for i, t in ((r[0], r[1] or "") for r in odd.select("doc_id", "text").collect()):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert told(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack_documents(odd.limit(0), WORD).count() == 0


def test_sum_of_squares():
    draw = np.random.default_rng(1)
    for capacity in (7, 64):
        lengths = draw.integers(1, capacity + 1, 400)
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        # one after another, by the definition
        gaps, want = [], []
        for s in lengths.tolist():
            count = lambda gs: sum(v * v for v in np.bincount([g for g in gs if 0 < g < capacity], minlength=capacity + 1).tolist())
            best = min([count([*gaps[:k], g - s, *gaps[k + 1 :]]) for k, g in enumerate(gaps) if g >= s] + [count([*gaps, capacity - s])])
            k = int(bins[len(want)])
            if k == len(gaps):
                gaps.append(capacity)
            assert offsets[len(want)] == capacity - gaps[k] and gaps[k] >= s
            gaps[k] -= s
            assert count(gaps) == best
            want.append(k)


# 9


def test_classifier(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = site_quality.train(docs, labels.where("doc_id % 2 = 0"))
    own = site_quality.evidence(docs, model)
    held = site_quality.score(own, site_quality.sites(own)).withColumn("doc_id", F.col("row.doc_id")).join(labels.where("doc_id % 2 = 1"), "doc_id").select("_kept", "quality").collect()
    assert sum(r["_kept"] == (r["quality"] == 1) for r in held) / len(held) > 0.95


def test_classifier_odd(spark, odd):
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = site_quality.report(odd, labels).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["doc_id"] in (0, 1, 2)) and all(r["kept"] for r in rows if r["doc_id"] in (3, 4, 5, 6))
    assert site_quality.report(odd.limit(0), labels.limit(0)).count() == 0
    kept = site_quality.keep(odd, site_quality.train(odd, labels))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


def test_posteriors_against_brute_force(spark, sf, docs):
    """Host and path posteriors, prior strengths and leave-one-out terms, recomputed document by document."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    extra = spark.createDataFrame([(None, None, None, None), (1, "x y z. " * 20, None, "en"), (1, "x y z. " * 20, None, "en"), (2, "", "src1", None)], "doc_id long, text string, source string, lang string")
    rows = docs.select("doc_id", "text", "source", "lang").unionByName(extra)
    own = site_quality.evidence(rows, site_quality.train(docs, labels))
    known = [(r["row"]["doc_id"], r["_host"], r["_path"], r["_words"], r["_p"]) for r in own.collect()]
    words = [x for x in known if x[3] > 0]

    def total(keep):
        some = [x[4] for x in words if keep(x)]
        return len(some), sum(some)

    n, s = total(lambda x: True)
    mean = s / n
    hosts = {h: total(lambda x, h=h: x[1] == h) for h in {x[1] for x in words}}
    paths = {k: total(lambda x, k=k: x[1:3] == k) for k in {x[1:3] for x in words}}
    spread = sum(c * (t / c - mean) ** 2 for c, t in hosts.values()) / n
    within = sum(c * (t / c - hosts[h][1] / hosts[h][0]) ** 2 for (h, _), (c, t) in paths.items()) / n
    of_host, of_path = (min(max(mean * (1 - mean) / v - 1, site_quality.WEAKEST), site_quality.STRONGEST) for v in (spread, within))
    want = []
    for i, h, k, count, p in known:
        one, share = (1, p) if count else (0, 0.0)
        (hn, hs), (pn, ps) = hosts.get(h, (0, 0.0)), paths.get((h, k), (0, 0.0))
        host = (hs - share + of_host * mean) / (hn - one + of_host)
        path = (ps - share + of_path * host) / (pn - one + of_path)
        logit = lambda x: np.log(x / (1 - x))
        final = 1 / (1 + np.exp(-(logit(p) + logit(path) - logit(mean))))
        want.append((i or -1, round(host, 6), round(path, 6), round(final, 6), bool(count and final >= 0.5)))
    got = [(r["row"]["doc_id"] or -1, round(r["_host_p"], 6), round(r["_path_p"], 6), round(r["_final"], 6), r["_kept"]) for r in site_quality.score(own, site_quality.sites(own)).collect()]
    assert np.allclose(np.array(sorted(got), float), np.array(sorted(want), float), atol=3e-6)


def test_shrinking(spark):
    rows = [(i, "x " * 60, "good" if i < 200 else "bad", "p") for i in range(400)] + [(999, "x " * 60, "rare", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = site_quality.Model((0.0,) * 7, 0.0, 0.5)
    own = site_quality.evidence(df, model).withColumn("_p", F.when(F.col("row.source") == "bad", 0.1).when(F.col("row.source") == "good", 0.9).otherwise(0.5))
    got = {r["row"]["source"]: r for r in site_quality.score(own, site_quality.sites(own)).collect()}
    assert got["good"]["_host_p"] > 0.85 and got["bad"]["_host_p"] < 0.15 and abs(got["rare"]["_host_p"] - 0.5) < 0.01


# 10


def match_rows():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgé") for _ in range(draw.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(14)
    rows = [(i, f"{text(draw.randint(0, 40))} {passage if draw.random() < 0.6 else ''} {line} {text(draw.randint(0, 60))}") for i in range(30)]
    rows += [(30, rows[0][1]), (31, rows[0][1] + "z"), (32, None), (33, ""), (34, "ab" * 400), (35, "ab" * 250), (36, "x" * 199), (37, "x" * 200), (38, rows[1][1][50:700]), (39, "Errere " * 90 + text(20)), (40, "Errere " * 70)]
    return rows + [(None, rows[2][1]), (5, rows[5][1]), (6, "other text " + passage)]


@pytest.mark.parametrize("limit", [1024, 2])
def test_long_matches(spark, monkeypatch, limit):
    monkeypatch.setattr(long_matches, "SPLIT", 8192)
    rows = match_rows()
    want = brute.long_matches(rows)
    got = [tuple(r) for r in long_matches.report(table(spark, rows), limit).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[4])) == [w[:5] for w in want]
    if limit == 2:
        left = long_matches.remove(table(spark, rows), limit)
        assert left.columns == table(spark, rows).columns
        assert sorted((r["doc_id"] or -1, r["text"] or "") for r in left.collect()) == sorted((w[0] or -1, w[5]) for w in want)


def test_long_matches_tables(spark, docs, texts):
    some = texts[:80]
    got = [tuple(r) for r in long_matches.report(docs.where(F.col("doc_id").isin([i for i, _ in some]))).collect()]
    assert sorted(got) == [w[:5] for w in brute.long_matches(some)]
    assert long_matches.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1024, 2])
def test_long_matches_of_equal_rows(spark, limit):
    """Equal rows without an id, in a number that anchors of all of them for each would square."""
    words = " ".join(f"w{i * 7919 % 1009}" for i in range(80))
    rows = [(None, words)] * 500 + [(1, "before " + words), (2, "other")]
    docs = table(spark, rows)
    found = long_matches.candidates(docs.select("doc_id", "text"))
    per = len(long_matches.winnow(words.encode())[3])
    assert found.where("x is not null" if "x" in found.columns else "pos is not null").select(F.max(F.size("pos"))).first()[0] <= per + 3
    got = long_matches.report(docs, limit).groupBy("doc_id").agg(F.count("*"), F.min("n_removed"), F.max("n_removed")).collect()
    n = len(words.encode())
    assert sorted(tuple(r) for r in got if r[0]) == [(1, 1, n, n), (2, 1, 0, 0)] and [tuple(r) for r in got if r[0] is None] == [(None, 500, n, n)]
    assert {len(r["text"]) for r in long_matches.remove(docs, limit).where("doc_id is null").collect()} == {0}


@pytest.mark.parametrize("share", [4096, 7])
def test_hot_passages_in_groups(spark, monkeypatch, share):
    """A passage that every document holds, some windows that two of different groups share, in groups of bounded size."""
    monkeypatch.setattr(long_matches, "SPLIT", share)
    dice = random.Random(share)
    own = lambda n: " ".join(f"w{dice.randrange(10**8)}" for _ in range(n))
    passage, tails = own(40), [own(9) for _ in range(12)]
    rows = [(k if k % 9 else None, f"{own(20)} {passage} {tails[k % 12] if k < 24 else own(9)} {own(5)}") for k in range(90)]
    docs = table(spark, rows)
    got = [tuple(r) for r in long_matches.report(docs, 10).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[4])) == [w[:5] for w in brute.long_matches(rows)]
    sent = long_matches.pieces(long_matches.candidates(docs.select("doc_id", "text")).where("text is not null"), 10)
    largest = sent.where("hot").groupBy("r", "sub").count().agg(F.max("count")).first()[0]
    assert largest <= (25 if share == 7 else 90)


def test_routes_of_null_ids(spark):
    """Rows without ids spread over as many routes as others."""
    dice = random.Random(2)
    own = lambda n: " ".join(f"w{dice.randrange(10**8)}" for _ in range(n))
    passages = [own(40) for _ in range(60)]
    for ids in ((None,) * 180, range(180)):
        docs = table(spark, [(i, f"{own(3)} {passages[k % 60]} {own(3)}") for k, i in enumerate(ids)])
        sent = long_matches.pieces(long_matches.candidates(docs.select("doc_id", "text")).where("text is not null"))
        assert sent.where("not hot").select("r").distinct().count() >= 60


def test_long_matches_of_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    got = {r["doc_id"]: r for r in long_matches.report(table(spark, [(1, long), (2, long[500_000:500_600]), (3, "y" * 100 + long[700_000:700_250])])).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"], got[3]["n_removed"]) == (850, 2, 600, 250)


def test_run_length_index(monkeypatch):
    draw = random.Random(9)
    for length in (3, 5, 12):
        monkeypatch.setattr(long_matches, "LENGTH", length)
        for _ in range(40):
            base = [bytes(draw.choice(b"ab\x00c") for _ in range(draw.randint(0, 50))) for _ in range(3)]
            strings = [b"".join(draw.choice(base)[draw.randint(0, 9) :] for _ in range(3)) for _ in range(draw.randint(1, 7))]
            seen = {}
            for s in strings:
                for i in range(len(s) - length + 1):
                    seen[s[i : i + length]] = seen.get(s[i : i + length], 0) + 1
            assert [x.tolist() for x in long_matches.long_matches(strings)] == [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
    index = long_matches.RunLengthIndex([b"abcabcabcabcabcabc" * 30, b"abcabcabc" * 30])
    assert index.runs < len(index.text) / 4
