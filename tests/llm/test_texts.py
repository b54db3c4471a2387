"""Operators on single texts: packing, token files, chat, pages, archives, toxicity."""

from __future__ import annotations

import hashlib
import io
import random
import time
import zlib
from html import unescape

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelog.llm import chat, html_text, toxicity, warc
from tidelog.llm import queries as Q
from tidelog.llm.packing import OpenWindows, best_fit_decreasing, pack, powers
from tidelog.llm.token_files import bits_for, pack_bits, read_token_files, unpack_bits, write_token_files
from tidelog.llm.tokens import encoder
from tidelog.stage import Stage

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "word " * 5000), (5, "x" * 3000), (None, "no id"), (6, "  \n \t  two   words \n"), (7, "<|endoftext|> it's 10\u00a0km")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, length string, sequence_id int")


def linear(f, make, sizes=(250_000, 1_000_000)):
    """Whether f's time for the larger input is about in proportion to that for the smaller one."""
    took = []
    for n in sizes:
        data = make(n)
        began = time.perf_counter()
        f(data)
        took.append(time.perf_counter() - began)
    return took[1] < 2.5 * sizes[1] / sizes[0] * max(took[0], 0.02)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(Q.TOKENIZER)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_words_give_the_ids_of_whole_texts(tokenizer):
    enc, rng = encoder(Q.TOKENIZER), random.Random(7)
    parts = [" ", " ", " ", "\n", "\t", "\u00a0", "\u2003", "\x85", "a", "Bc", "é", "'s", "1", ".", "!!", "_", "²", "e\u0301", "<|endoftext|>", "### ", "x" * 300]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_cut_at_safe_places(tokenizer, monkeypatch):
    from tidelog.llm import tokens

    rng = random.Random(5)
    text = "".join(rng.choices(["a", "bc", " ", " ", "\n", "  ", "'s", "é", "12", "!"], k=3000))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "_BIG", 100)
    assert [x.tolist() for x in encoder(Q.TOKENIZER).encode([text, "a", None, text[:50]])] == [want, tokenizer.encode("a").ids, [], tokenizer.encode(text[:50], add_special_tokens=False).ids]
    monkeypatch.setattr(tokens, "_PART", 50)
    assert np.frombuffer(encoder(Q.TOKENIZER)._direct(text), "<u4").tolist() == want


def test_packing_covers_each_token_once(spark, tokenizer):
    rows = pack(docs(spark), Q.TOKENIZER, size=256).collect()
    for key, text in set(ODD):
        ids, n = ids_of(tokenizer, text), ODD.count((key, text))
        mine = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        assert sum(r.length for r in mine) == n * len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and {r.sequence_tokens for r in pieces} == {at}
        assert at & (at - 1) == 0 or at >= 240  # a power of two, or nearly full


@pytest.mark.parametrize("tasks", [1, 4, 64])
def test_padding_does_not_depend_on_the_tasks(spark, sf_dir, tasks):
    rows = pack(Q.table(spark, sf_dir, "documents").repartition(tasks), Q.TOKENIZER).groupBy("sequence_id").agg({"length": "sum"}).collect()
    tokens = sum(r[1] for r in rows)
    padding = sum(1024 - r[1] for r in rows if r[1] & (r[1] - 1))
    assert padding <= 0.01 * tokens


def test_powers_add_up():
    assert all(sum(powers(n)) == n and powers(n) == sorted(powers(n), reverse=True) for n in range(1025))
    assert powers(0) == [] and powers(1000) == [512, 256, 128, 64, 32, 8]


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 101, 200)
        window, offset, used = best_fit_decreasing(lengths, 100)
        free, where = [], []
        for n in sorted(lengths.tolist(), reverse=True):  # the same, by looking at all windows
            fits = [w for w, f in enumerate(free) if f >= n]
            w = min(fits, key=lambda w: free[w]) if fits else len(free)
            if w == len(free):
                free.append(100)
            free[w] -= n
            where.append(w)
        assert used == len(free)
        assert sorted(np.bincount(window, lengths, used).tolist()) == sorted(100 - f for f in free)
    tree = OpenWindows(10)
    tree.put(1, 4)
    tree.put(2, 7)
    assert tree.take(5) == (2, 7) and tree.take(5) is None and tree.take(1) == (1, 4)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype("<u4")
    assert (unpack_bits(pack_bits(ids, bits), 1000, bits) == ids).all()
    assert bits_for(2**bits) == bits


def test_token_files_round_trip(spark, tokenizer):
    rows = read_token_files(write_token_files(docs(spark), Q.TOKENIZER, Stage(spark, "test"))).collect()
    want, at = [], 0
    for key, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = ids_of(tokenizer, text)
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.start)] == want


def test_token_files_roll(spark, tokenizer):
    stage = Stage(spark, "test")
    manifest = write_token_files(docs(spark), Q.TOKENIZER, stage, roll=6000, roll_docs=3)
    assert manifest.count() > 2 and max(r.docs for r in manifest.collect()) <= 3
    whole = read_token_files(write_token_files(docs(spark), Q.TOKENIZER, Stage(spark, "test")))
    assert sorted(map(str, read_token_files(manifest).collect())) == sorted(map(str, whole.collect()))


NOTHING = [
    lambda s: pack(docs(s).limit(0), Q.TOKENIZER),
    lambda s: read_token_files(write_token_files(docs(s).limit(0), Q.TOKENIZER, Stage(s, "empty"))),
    lambda s: html_text.extract(s.createDataFrame([], "page_id long, url string, html string")),
    lambda s: chat.digests(chat.format_turns(s.createDataFrame([], "conv_id long, turn long, role string, text string"), Q.TOKENIZER), Q.TOKENIZER),
    lambda s: toxicity.score(docs(s).limit(0), toxicity.Lexicon({" bad ": 2.0}, ())),
    lambda s: toxicity.keep_clean(docs(s).limit(0), toxicity.Lexicon({" bad ": 2.0}, ())),
]


@pytest.mark.parametrize("f", NOTHING)
def test_empty_tables(spark, f):
    assert f(spark).count() == 0


# --------------------------------------------------------------------------- chat


PARTS = ["\\", "#", "##", "###", ":", "</turn>", "<|endoftext|>", "<|endof", "text|>", "a", " ", "é"]


def test_no_control_string_is_left_and_escapes_round_trip():
    enc, escapes, rng = encoder(Q.TOKENIZER), chat.Escapes.of(Q.TOKENIZER), random.Random(3)
    controls = [t.content for t in enc.tokenizer.get_added_tokens_decoder().values()]
    assert controls
    texts = [*controls, "\\### Assistant: </turn> ok", *("".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(3000))]
    for role in (False, True):
        hidden = [escapes.escape(t, role) for t in texts]
        assert [chat.unescape(h) for h in hidden] == texts
        assert not [h for h in hidden for c in ("###", "</turn>", *controls) if c in h]
        added = set(enc.tokenizer.get_added_tokens_decoder())
        assert not [h for h, ids in zip(hidden, enc.encode(hidden), strict=True) if not added.isdisjoint(ids.tolist())]
    with pytest.raises(ValueError, match="escaped"):
        chat.Escapes(["x"])


def test_content_makes_no_reserved_id(spark):
    said = "a <|endoftext|> b ### : </turn>"
    turns = spark.createDataFrame([(1, 0, said, said), (1, 1, "assistant", said * 3)], "conv_id long, turn long, role string, text string")
    size = encoder(Q.TOKENIZER).size
    added = set(encoder(Q.TOKENIZER).tokenizer.get_added_tokens_decoder())
    for r in chat.format_turns(turns, Q.TOKENIZER).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert [i - size for i in ids if i >= size] == [0, 1, 2] and added.isdisjoint(ids)


def test_conversations_read_back(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 1, "assistant", "b\n"), (1, 0, "user", None), (1, None, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "sys: tem", "é" * 900)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns, Q.TOKENIZER), Q.TOKENIZER).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        pairs = [(r[2] or "", r[3] or "") for r in mine]
        loss = "".join(t for r, t in pairs if r == "assistant")
        x = got[conv]
        assert x.n_turns == len(mine)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    starts = chat.format_turns(turns, Q.TOKENIZER).filter("conv_id = 1").orderBy("start").collect()
    assert [r.start for r in starts] == [0, starts[0].n_tokens, starts[0].n_tokens + starts[1].n_tokens]


# --------------------------------------------------------------------------- pages


def main(html):
    return html_text.main_text(html, html_text.train())[0]


def test_main_text_of_a_page_with_everything_around():
    html = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/a>A</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site to make it work for all of you, do you agree?</div><main><article><h1>Head &amp; line</h1><p>One <b>bold</b>
    word&nbsp;&lt;here&gt;.<p>Second<script>var x="</p><p>no";</script> part.</p><form><label>Mail</label><input></form><!-- <p>gone</p> --><p>1 < 2</p></article></main>
    <aside>Links: <a href=x>more of these</a></aside><section id="comments"><p>A reader says that this is a long and thoughtful comment about it all.</p></section><footer>&copy; 2024</footer></body></html>"""
    assert main(html) == "Head & line\nOne bold word <here>.\nSecond part.\n1 < 2"


@pytest.mark.parametrize("html", [None, "", " ", "<p>", "<script>x", "<!-- open", "<nav><a href='x'>A</a></nav>", "<a b='c", "<"])
def test_pages_without_text(html):
    assert main(html) in ("", "<") and isinstance(main(html), str)


def test_pages_of_the_table(spark, sf_dir):
    import re

    rows = Q.op2_html_text(spark, sf_dir).join(Q.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("part", ["<a ", '<a "b>" ', "<div></section>", "</script ", "<![x", "<p>&amp; ", "<a href=x>y ", "a < b "])
def test_time_grows_with_the_page(part):
    tree = html_text.train()
    assert linear(lambda h: html_text.main_text(h, tree), lambda n: part * (n // len(part)) + "'")


def test_very_long_pages():
    text = " ".join(f"word{i % 977} and more of it." for i in range(400_000))
    assert main(f"<html><body><nav><a href=x>A</a></nav><article><p>{text}</p></article></body></html>") == text


def test_references_and_open_links():
    assert main("<article><p>Some text of a page, with a &<b>amp;</b> b, &lt;c> and &amp;lt; in it.</p></article>") == "Some text of a page, with a &amp; b, <c> and &lt; in it."
    long = "Here is a sentence of an article that goes on for quite some words and ends in the end."
    html = f"<body><article><div><a href=x>open</div><p>{long}</p><p>{long} Again.</p></article></body>"
    assert [b[2] for b in html_text.blocks(html)] == [1.0, 0.0, 0.0]


# --------------------------------------------------------------------------- archives


def archive(n, compress):
    import gzip

    out, at = b"", [0]
    for i in range(n):
        data = warc.record_bytes(i, f"http://x/{i}", f"page {i}".encode() * (i + 1), warc.digest(f"page {i}".encode() * (i + 1)), None, False)
        out += gzip.compress(data) if compress else data
        at.append(len(out))
    return out, at


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    data, at = archive(6, compress)
    bad = bytearray(data)
    bad[at[2] - 9] ^= 255  # damage in the second record's content
    bad[at[3] : at[3]] = b"noise\x1f\x8b\x08 WARC/1.0 junk"  # junk before the fourth
    bad = bytes(bad[:-5])  # and the last is cut short
    rows = list(warc.salvage(io.BytesIO(bad)))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [0, 2, 3, 4]
    gaps = [(r["start"], r["stop"]) for r in rows if r["kind"] == "gap"]
    assert gaps[-1][1] == len(bad)
    covered = sorted((r["start"], r["stop"]) for r in rows)
    assert covered[0][0] == 0 and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_holds_little(compress, monkeypatch):
    rng = random.Random(2)
    records = [warc.record_bytes(i, "u", p := rng.randbytes(50_000), warc.digest(p), None, False) for i in range(200)]
    if compress:
        import gzip

        records = [gzip.compress(r) for r in records]
    data = bytearray(b"".join(records))
    data[len(records[0]) + 600] ^= 255
    most, more = [0], warc._Bytes.more
    monkeypatch.setattr(warc._Bytes, "more", lambda self: (more(self), most.append(max(most.pop(), len(self.data))))[0])
    rows = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [r["page_id"] for r in rows if r["kind"] == "record"] == [0, *range(2, 200)]
    assert most[0] < 3 << 20 < len(data)


@pytest.mark.parametrize("junk", [b"WARC/1.1\r\n", b"WARC/1.1\r\n\r\n", b"\x1f\x8b\x08\x00aa", b"WARC/1.1 \x1f\x8b\x08"])
def test_false_marks_take_linear_time(junk):
    assert linear(lambda d: [r["kind"] for r in warc.salvage(io.BytesIO(d))] == ["gap"] or 1 / 0, lambda n: junk * (n // len(junk)))


def test_archives_round_trip(spark):
    rows = [(1, "http://a b\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é"), (5, "u", "é"), (None, "u", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.read_archives(warc.write_archives(pages, Stage(spark, "test"))).collect()
    want = [(1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 2, "response", None), (5, 2, "response", None), (None, 4, "revisit", 2)]
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.payload_digest for r in got if r.payload_bytes == 4} == {warc.digest(b"same")}
    assert warc.read_archives(warc.write_archives(pages.limit(0), Stage(spark, "none"))).count() == 0


# --------------------------------------------------------------------------- toxicity


def test_folding():
    assert toxicity.fold("Ѕtup1d, 1d10t$$$ m@ron!!\u200b") == " stupid idiot maron "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_exceptions_and_weights():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " idio": 3.0, " idiot ": 4.0}, ("trash can",))
    found = lexicon.automaton()
    assert toxicity.matches(found, toxicity.fold("an IDIOT and trash")) == (6.0, 2)
    assert toxicity.matches(found, toxicity.fold("the trash can is full")) == (0, 0)
    assert toxicity.matches(found, toxicity.fold("")) == (0, 0)


def test_time_grows_with_the_text():
    found = toxicity.Lexicon({" trash ": 2.0, " can ": 1.0}, ("trash can",)).automaton()
    assert linear(toxicity.fold, lambda n: "a@b $ " * (n // 6))
    assert linear(lambda t: toxicity.matches(found, t), lambda n: toxicity.fold("trash can " * (n // 10)))
    assert toxicity.matches(found, toxicity.fold("trash can " * 1000 + "trash")) == (2.0, 1)


def test_exceptions_are_learned(spark):
    rows = [(i, f"you are such trash number {i}") for i in range(1, 60)] + [(i, f"the trash can of room {i} is full") for i in range(100, 104)] + [(i, f"a fine day number {i} for all") for i in range(200, 300)]
    rows += [(300, "z" * 50 + " trash"), (301, "z" * 50)]
    labels = spark.createDataFrame([(i, int("such trash" in t or "zz" in t)) for i, t in rows], "doc_id long, toxic int")
    lexicon = toxicity.train(docs(spark, rows), labels, Stage(spark, "test"))
    assert {p.split()[0] for p in lexicon.weights} & {"trash", "tras", "such"}
    if any(p.strip() in ("trash", "tras") for p in lexicon.weights):
        assert "trash can" in lexicon.exceptions
    got = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, [(1, "you are such trash"), (2, "the trash can is full"), (3, None), (3, "")]), lexicon).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_held_out_accuracy(spark, sf_dir):
    scored = Q.op6_toxicity(spark, sf_dir).join(Q.table(spark, sf_dir, "labels"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in scored)
    assert right >= 0.85 * len(scored)
    assert all(0 <= r.score <= 1 for r in scored)


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs(spark), labels, Stage(spark, "test"))
    assert lexicon.weights == {}
    rows = toxicity.score(docs(spark), lexicon).collect()
    assert len(rows) == len(ODD) and {r.predicted for r in rows} == {0}
    assert toxicity.keep_clean(docs(spark), lexicon).count() == len(ODD)
