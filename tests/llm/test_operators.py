"""Each operator against brute force on small fixtures with nulls, empty and very long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestar.llm import bpe, line_dedup, minhash, mixing, pii, quality, queries, sentence_spans, suffix_dedup, topk, url_filter
from lodestar.llm.components import components
from lodestar.llm.runindex import RunIndex, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary():
    return [a + b for a in "ba de ki lo mu ne po ra si tu".split() for b in "ba de ki lo mu ne po ra si tu".split()]


def corpus(seed=0, n=120):
    """Documents with copies, near copies, shared passages and lines, nulls, empty and long texts, repeated rows."""
    rng, words = random.Random(seed), vocabulary()
    passage = " ".join(rng.choice(words) for _ in range(120))
    texts = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        if texts and rng.random() < 0.3:  # a copy, with a few words changed
            t = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
            continue
        if rng.random() < 0.2:
            t = t[:20] + [passage] + t[20:]
        lines, k = [], 0
        while k < len(t):
            m = rng.randint(4, 15)
            lines.append(" ".join(t[k : k + m]) + ".")
            k += m
        if rng.random() < 0.4:
            lines.insert(0, "Read more here!")
        texts.append("\n".join(lines).replace(".\n", ".\n") if rng.random() < 0.8 else " ".join(lines))
    texts += [None, "", " \t\n", "one", "Two WORDS", "é ü ñ " * 40, "x" * 30_000, ("ab " * 9000).strip(), "a\nb\na\nb"]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 5}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[5], None, "src1", 5), (None, texts[5], None, "src1", 5)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# 1


def test_line_dedup(docs, rows, none):
    pages, counts = collections.Counter(r[3] for r in rows), collections.Counter()
    for r in rows:
        counts.update((r[3], x) for x in {x for x in (r[1] or "").split("\n") if WORD.search(x)})
    want = collections.Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not counts[r[3], x] - 1 > 0.1 * (pages[r[3]] - 1)]
        want[r[0], len(lines), len(lines) - len(kept), None if r[1] is None else "\n".join(kept)] += 1
    out = line_dedup.remove_boilerplate(docs.withColumn("n_lines", F.lit("clash")), "source")
    assert bag(out, "doc_id", "n_lines", "n_dropped", "text") == want and out.filter("n_dropped > 0").count()
    assert line_dedup.remove_boilerplate(none, "source").count() == 0


def test_line_dedup_of_small_sites(spark):
    """A site's only page, and lines of one page, stay in sites of any size."""
    rows = [(1, "one", "a\nb"), (2, "two", "x\ny"), (3, "two", "x\nz"), (4, "four", "p\nq"), (5, "four", "r\nq"), (6, "four", "s\n"), (7, "four", "t\n\n")]
    out = {r.page_id: r.text for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "page_id long, host string, text string"), "host").collect()}
    assert out == {1: "a\nb", 2: "y", 3: "z", 4: "p", 5: "r", 6: "s\n", 7: "t\n\n"}


def test_html_lines(spark):
    html = "<!DOCTYPE html><head><title>T</title><style>p{}</style><SCRIPT>x = '</p>';</SCRIPT></head>\n<body><!-- <p>no -->  <p>a <b>b</b><br/>c</p>\n <ul><li>1 < 2</li><li> </li></ul></body>"
    df = spark.createDataFrame([(html,), (None,), ("",), ("plain",)], "html string").select(line_dedup.html_lines(F.col("html")))
    assert [r[0] for r in df.collect()] == ["T\na b\nc\n1 < 2", None, "", "plain"]


def test_line_dedup_without_broadcast(docs, monkeypatch):
    want = bag(line_dedup.remove_boilerplate(docs, "source"), "doc_id", "text")
    monkeypatch.setattr("lodestar.llm.common.BROADCAST_BYTES", -1)
    assert bag(line_dedup.remove_boilerplate(docs, "source"), "doc_id", "text") == want


# 2


def repeated(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, upto = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[max(i, upto) : i + length] = b"\x01" * (i + length - max(i, upto))
                upto = i + length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_run_index():
    rng = random.Random(3)
    for _ in range(60):
        t = np.array([rng.choice([0, 1, 255]) for _ in range(rng.randint(1, 120))], np.uint8)
        b = t.tobytes()
        assert suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        index = RunIndex(t)
        assert index.lengths.sum() == len(b) and (index.symbols[1:] != index.symbols[:-1]).all()

        def common(i, j, b=b):
            k = 0
            while max(i, j) + k < len(b) and b[i + k] == b[j + k]:
                k += 1
            return k

        assert index.matches().tolist() == [max([common(i, j) for j in range(len(b)) if j != i] or [0]) for i in range(len(b))]


@pytest.mark.parametrize(("length", "anchor", "most"), [(400, 64, 8192), (60, 10, 8192), (60, 10, 3)])
def test_suffix_dedup(docs, rows, length, anchor, most):
    want = collections.Counter((r[0], *w) for r, w in zip(rows, repeated([(r[1] or "").encode() for r in rows], length), strict=True))
    clash = docs.withColumn("key", F.lit("clash")).withColumn("marks", F.lit(1))
    assert bag(suffix_dedup.repeated_bytes(clash, length=length, anchor=anchor, most=most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup_of_nothing(none):
    assert suffix_dedup.repeated_bytes(none).count() == 0


# 3


@pytest.mark.parametrize("block", [mixing.BLOCK, 7])
def test_mixing(docs, rows, none, block):
    m = mixing.Mix(mixing.sized(docs.drop("lang")).drop("text"), light=True, block=block)
    assert {r.source: r["size"] for r in m.sources.collect()} == {s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    total = sum(len(WORD.findall(r[1] or "")) for r in rows)
    taken = m.taken().groupBy("__source").agg(F.sum("words").alias("n")).join(m.sources, "__source").collect()
    assert sum(r.target for r in taken) == pytest.approx(total)
    for r in taken:
        assert abs(r.n - r.target) <= 0.5 and r.target <= 3 * r["size"]
    each = m.taken().groupBy("__source", "__start").agg(F.sum("words").alias("n")).join(m.placed.filter("__size > 0"), ["__source", "__start"]).collect()
    assert all(r.n <= 3 * r["__size"] for r in each)
    slots = m.slots().collect()
    assert len({(s["__source"], s["rank"]) for s in slots}) == len(slots)
    assert mixing.mixed(none).count() == 0
    assert mixing.Mix(mixing.sized(none)).taken().count() == 0


def test_schedule_is_even(docs):
    m = mixing.Mix(mixing.sized(docs).drop("text"), light=True, block=1)
    slots, share = m.slots().collect(), {r["__source"]: r.target for r in m.sources.collect()}
    total = sum(share.values())
    first = [s["__source"] for s in slots if s.slot < 400]
    for s, n in collections.Counter(first).items():
        assert abs(n - len(first) * share[s] / total) < 12


def test_targets(spark):
    sizes = spark.createDataFrame([("a", "va", 10), ("b", "vb", 1000), ("c", "vc", 90), (None, "n", 900)], "source string, __source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a is full at three times its size; the rest goes by the weights 2, 1, 5 of b, c and null, the last
    assert got == {"a": 30, "b": 1970 * 2 / 8, "c": 1970 / 8, None: 1970 * 5 / 8}


def test_mixed_texts(docs, rows):
    out = mixing.mixed(docs).collect()
    texts = {r[0]: r[1] for r in rows}
    total = sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert abs(sum(len(WORD.findall(r.text)) for r in out) - total) <= 6
    for r in out:
        if r.doc_id is not None:
            assert " ".join(WORD.findall(r.text)) in " ".join(WORD.findall(texts[r.doc_id]))
    again = collections.Counter(map(tuple, mixing.mixed(docs.repartition(7)).collect()))
    assert again == collections.Counter(map(tuple, out))
    # columns named like the operator's own pass through; equal rows are taken in either order
    clash = mixing.mixed(docs.withColumn("__size", F.lit("clash")).withColumn("pass", F.lit(1.5)))
    assert collections.Counter(map(tuple, clash.drop("__size", "pass").collect())) == again and clash.filter("__size = 'clash' and pass = 1.5").count() == len(out)


# 4

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, none, encoding):
    want = collections.Counter()
    for r in rows:
        ids = encoding.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert bag(bpe.digests(docs, PATH, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    coded = bpe.encode(docs.withColumn("ids", F.lit(1)), PATH, public_tokenizers.PATTERN)
    back = bpe.decode(coded, PATH, public_tokenizers.PATTERN)
    assert collections.Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == collections.Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_words(encoding):
    codec, rng = bpe.codec(PATH, public_tokenizers.PATTERN), random.Random(1)
    texts = ["a" * 1000, "=" * 700, "".join(rng.choice("abcdeé") for _ in range(3000)), "日本語" * 200, "<|endoftext|> it's 12345\n\n  x ", *["".join(chr(rng.choice([*range(32, 127), 233, 8364, 0x1F600])) for _ in range(60)) for _ in range(50)]]
    for t, pieces in zip(texts, codec.encode(texts), strict=True):
        assert [int(i) for p in pieces for i in p[0].split()] == encoding.encode_ordinary(t)
    with pytest.raises(ValueError, match="vocabulary"):
        codec.decode([[50_256_000]])


# 5


def test_url_filter(spark):
    ts = lambda s: f"2024-01-{s} 00:00:00"
    entries = spark.createDataFrame([("bad.org", True, ts("02")), ("bad.org", False, ts("05")), ("bad.org", True, ts("05")), ("bad.org", False, ts("07")), ("x.bad.org", True, ts("10")), ("X.BAD.ORG", True, ts("10")), (None, True, ts("01")), ("ok.org", None, ts("01"))], "domain string, listed boolean, at string").withColumn("at", F.to_timestamp("at"))
    pages = [(1, "http://bad.org/a", "01", None), (2, "http://x.bad.org/", "02", "bad.org"), (3, "https://me@X.bad.ORG:8080?q", "06", "bad.org"), (4, "http://bad.org", "07", None), (5, "http://x.bad.org", "11", "x.bad.org"), (6, "http://notbad.org/bad.org", "03", None), (7, None, "03", None), (8, "no url", "03", None), (9, "http://bad.org/a", "03", "bad.org"), (9, "http://bad.org/a", "03", "bad.org"), (10, "http://localhost/", "03", None), (11, "http://ok.org/", "03", None)]
    captures = spark.createDataFrame([(i, u, ts(d), "clash") for i, u, d, _ in pages], "page_id long, url string, at string, host string").withColumn("fetched_at", F.to_timestamp("at"))
    out = url_filter.judge(captures, entries)
    assert bag(out, "page_id", "blocked", "blocked_by") == collections.Counter((i, b is not None, b) for i, _, _, b in pages)
    assert url_filter.judge(captures, entries.filter("false")).filter("blocked").count() == 0
    assert url_filter.judge(captures.filter("false"), entries).count() == 0


# 6


def cut_up(t):
    """(start, end, words) of each sentence; from the first word to the next sentence's first word, or the text's end."""
    found, out = list(WORD.finditer(t or "")), []
    for k, m in enumerate(found):
        if not k or out[-1][3]:
            out.append([m.start(), 0, [], False])
        after = t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)]
        out[-1][1] = m.end() + len(after)
        out[-1][2].append(re.sub("[A-Z]", lambda x: x.group().lower(), m.group()))
        out[-1][3] = m.group()[-1] in ".!?,;:" or "\n" in after or "\r" in after
    return [(a, b, w) for a, b, w, _ in out]


def spans_of(s, span=3, words=20, long=50):
    for i in range(len(s)):
        held = []
        for j in range(i, len(s)):
            held += s[j][2]
            if len(held) >= long or j - i + 1 >= span and len(held) >= words or len(s) < span and not i and j == len(s) - 1 and len(held) >= words:
                yield i, j, tuple(held)
                break


def without_repeats(rows, **how):
    last = 2**63 - 1
    texts = {(r[0] if r[0] is not None else last, r[1] or ""): cut_up(r[1]) for r in rows}
    found = collections.defaultdict(list)
    for place, s in texts.items():
        for i, j, w in spans_of(s, **how):
            found[w].append((*place, i, j))
    gone = collections.defaultdict(set)
    for places in found.values():
        for p in places:
            if p[:3] != min(places)[:3]:
                gone[p[:2]].update(range(p[2], p[3] + 1))
    for r in rows:
        t = r[1] or ""
        s, g = cut_up(t), gone[r[0] if r[0] is not None else last, t]
        kept = "".join(t[a:b] for k, (a, b, _) in enumerate(s) if k not in g)
        yield r[0], len(s), len(g), t[: s[0][0] if s else len(t)] + kept


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_sentence_spans(docs, rows, none, chunk, monkeypatch):
    monkeypatch.setattr(sentence_spans, "CHUNK", chunk)
    want = collections.Counter(without_repeats(rows))
    out = sentence_spans.remove_repeated(docs.withColumn("id", F.lit("clash")).withColumn("marks", F.lit(1)))
    assert bag(out, "doc_id", "n_sentences", "n_removed", "text") == want and out.filter("n_removed > 0").count()
    assert sentence_spans.remove_repeated(none).count() == 0


def test_passages_in_other_texts(spark):
    """A passage of over 50 words goes from every text but the first, whatever it stands in, but for a clause at its edges."""
    rng, words = random.Random(31), vocabulary()
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    passage = say(65)
    texts = [f"{say(30)} {passage} {say(30)}" for _ in range(20)] + [say(80) for _ in range(20)]
    out = {r.doc_id: r for r in sentence_spans.remove_repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    middle = " ".join(passage.split(" ")[15:50])
    assert [i for i, t in enumerate(texts) if out[i].text == t] == [0, *range(20, 40)]
    assert middle in out[0].text and not any(middle in out[i].text for i in range(1, 20))


# 7

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((c if i % 2 == 0 else c * 2 - 9 * (c > 4)) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    fine = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if fine[k](m.group())] for k, p in KINDS.items()}


def test_pii_base(spark, none):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1. @+-5()é ") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", None, "", "4111 1111 1111 1111 x", "+1 (017) 555-7713", "9" * 20_000, "a" * 50_000, "a@" * 9000, "+1" + "(" * 20_000, "+1 " * 3000, "4111111111111111"]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in pii.digest(pii.find(df)).collect():
        want = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(x for v in want.values() for x in v).encode()).hexdigest()
        assert set(x for v in want.values() for x in v) <= set(r.spans.split(","))
    assert pii.find(none).count() == 0


def test_pii_bootstrap(spark):
    texts = [f"please mail to user{i}@site{i}.example.com today" for i in range(12)] + ["please mail to user77(at)host99887 today", "nothing before 12345678 to see", "gate number 55512345 is open", "host address is 10.0.0.7 now"]
    texts += [f"server host address is 10.1.{i}.9 now" for i in range(9)] + ["server host address is node-4411-77 now", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}

    def found(i):
        return [(s.split(":")[0], texts[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in out[i].spans.split(",") if s]

    assert found(12) == [("email", "user77(at)host99887")] and out[12].n_email == 0
    assert found(25) == [("ip", "node-4411-77")]
    assert found(13) == [] and found(14) == [] and found(0) == [("email", "user0@site0.example.com")]


def test_pii_of_whole_seeds(spark):
    """Identifiers with blanks seed patterns as a whole, every token has words of its own before it, and secrets are found."""
    texts = [f"ring us on +1 (0{i}7) 555-77{i:02d} today" for i in range(10, 22)] + ["ring us on 0175557799 today", "paid with card 4111 1111 1111 1111 then"]
    texts += [f'the token = "{hashlib.sha1(bytes([i])).hexdigest()}" goes' for i in range(8)] + ['my token = "XK-2209-11-7751" goes', "x 111222 333444 555666", "deed" * 10, "=" * 40 + " 1" * 40]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    out = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    found = lambda i: [(s.split(":")[0], texts[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in out[i].spans.split(",") if s]
    assert found(0) == [("phone", "+1 (0107) 555-7710")] and found(12) == [("phone", "0175557799")] and found(13) == [("card", "4111 1111 1111 1111")]
    assert all([k for k, _ in found(14 + i)] == ["secret"] for i in range(8)) and found(22) == [("secret", "XK-2209-11-7751")]
    assert all(found(i) == [] for i in (23, 24, 25)) and out[22].n_spans == 1


def test_pii_held_out(spark, monkeypatch):
    """Of secrets half of which are kept from the seeds all are found, and random tokens after random words are not."""
    rng, words = random.Random(17), vocabulary()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    keys = [hashlib.sha1(bytes([i])).hexdigest() for i in range(40)]
    texts = [f'{say(9)} token = "{k}" {say(5)} {rng.randrange(10**15, 10**16)} {say(3)} 10.{i}.1.2 {say(4)} item {i} of 40' for i, k in enumerate(keys)]
    monkeypatch.setattr(pii, "SECRET", r"^[0-7][0-9a-f]{39}$")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.find(df)).collect():
        more = [texts[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",")) if k == "secret"]
        assert more == [keys[r.doc_id]] and r.n_spans == 1 + r.n_email + r.n_ip + r.n_card + r.n_phone


def test_pii_of_a_long_text(spark):
    """A megabyte of candidates is worked on in a time that grows with its length."""
    took = []
    for n in (10_000, 80_000):
        df = spark.createDataFrame([(0, "a b 1.2.3.x " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.digest(pii.find(df)).first().n_spans == 0
        took.append(time.perf_counter() - began)
    assert took[1] < 60 and took[1] < 12 * took[0] + 10


# 8


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs, rows, none):
    want = collections.Counter((r[0], *(m := measured(r[1])), m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in rows)
    stats = quality.with_statistics(docs.withColumn("n_words", F.lit("clash")))
    assert bag(stats, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality.assess(none).count() == 0


def estimate(x):
    """Concentration steps in numpy, on all rows of a group, from both starts; the distances from the fit of the least determinant."""
    floors = np.array(quality.FLOORS) * quality.SCALE
    low = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    scatter = lambda v: (v.mean(axis=0), v.T @ v / len(v) - np.outer(v.mean(axis=0), v.mean(axis=0)) + np.diag(floors**2))
    away = lambda f: np.einsum("ij,jk,ik->i", x - f[0], np.linalg.inv(f[1]), x - f[0])
    det = lambda f: np.linalg.slogdet(f[1])[1] / 2
    fits = []
    for fit in ((low(x), np.diag((1.4826 * low(np.abs(x - low(x)))) ** 2 + floors**2)), scatter(x)):
        best = None
        while True:
            b = np.floor(quality.BINS * np.log2(away(fit) + 1))
            fit = scatter(x[b <= np.sort(b)[int(np.ceil(quality.SUPPORT * len(b))) - 1]])
            if best is not None and not det(fit) < det(best) - quality.LESS:
                break
            best = fit
        fits.append(best)
    best = min(fits, key=det)
    return away(best), det(best)


def test_quality_outliers(spark):
    rng, words = random.Random(9), vocabulary()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 300))) for _ in range(150)]
    texts += [" ".join(rng.choice(words) + "$$$#" for _ in range(100)) for _ in range(9)] + ["y" * 400 + " " + " ".join(rng.choice(words) + "z" * 60 for _ in range(40))]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.assess_ids(df).collect()}
    assert [i for i in range(len(texts)) if not out[i].kept] == list(range(150, 160))
    stats = [measured(t) for t in texts]
    x = np.array([[np.log1p(n), c / n, np.log1p(10 * s / n), 0.0, r / n] for n, c, s, _, r in stats])
    x = np.round(x * quality.SCALE)
    want, det = estimate(x)
    assert np.allclose([out[i].distance2 for i in range(len(texts))], want, rtol=1e-6)
    # no random three quarters of the rows have a lesser determinant
    floors = np.diag((np.array(quality.FLOORS) * quality.SCALE) ** 2)
    some = [np.random.default_rng(i).choice(len(x), int(np.ceil(quality.SUPPORT * len(x))), replace=False) for i in range(200)]
    assert det < min(np.linalg.slogdet(np.cov(x[i].T, bias=True) + floors)[1] / 2 for i in some)


def test_quality_of_small_groups(spark, monkeypatch):
    """Outliers of groups too small for an estimate are found by that of their language, or of all rows."""
    rng, words = random.Random(10), vocabulary()
    plain = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 300)))
    odd = lambda: " ".join(rng.choice(words) + "$$$#" for _ in range(100))
    rows = [(i, plain(), "en", f"s{i % 20}") for i in range(100)] + [(i, plain(), None, "s") for i in range(100, 105)]
    rows += [(200, odd(), "en", "s3"), (201, odd(), "en", "new"), (202, odd(), "de", "new"), (203, odd(), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.assess_ids(df).collect()}
    assert [i for i in sorted(out) if not out[i].kept] == [200, 201, 202, 203]
    assert all(r.distance2 is not None for r in out.values())
    few = quality.assess(df.filter("doc_id in (1, 2, 3, 200)")).collect()
    assert all(r.distance2 is not None for r in few)


# 9


@pytest.mark.parametrize("shard", [1 << 19, 1000])
def test_topk(spark, shard, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)) / 4
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (None, rows[1][1]), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (2200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    good = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for i, q in good:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:10]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert topk.top_k(df.filter("false"), df).count() == 0


def test_topk_of_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e6, 2e6]), (100, [3e6, -1e6]), (7, [2e6, 2e6])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id): r.score for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), 10).collect()}
    assert got[0, 1, 7] == 1024**2 * 6 * 10**12 and len(got) == 4


def test_topk_of_wide_vectors_and_repeated_rows(spark):
    """65,536 components; and a row repeated more often than a shard holds rows, each of which counts."""
    rng = np.random.default_rng(6)
    wide = [(i, rng.integers(-3, 4, 65_536).astype(float).tolist()) for i in range(20)]
    rows = wide + [(50, [1.0, 2.0])] * 300 + [(100, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id in (0, 100)"), 3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    m = 1024 * np.array([v for _, v in wide])
    best = sorted((-int(m[0] @ m[i]), i) for i in range(1, 20))[:3]
    assert sorted(got[0]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got[100]) == [(n, 50, 4 * 1024**2) for n in (1, 2, 3)]


# 10


def sets_of(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def grouped(rows):
    ids = [(r[0], sets_of(r[1])) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(ids):
        for j, b in ids[:n]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in ids}


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark, none, seed):
    rows = corpus(seed, 160)
    part = grouped(rows)
    want = collections.Counter((r[0], len(sets_of(r[1])), part.get(r[0]), part.get(r[0], r[0]) == r[0]) for r in rows)
    got = bag(minhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash"))), "doc_id", "n_shingles", "component_id", "kept")
    assert got == want and len(set(part.values())) < len(part) - 8
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    """Groups larger than a node go down the trees, and in the end into blocks; no link is lost."""
    rng, words = random.Random(8), vocabulary()
    first = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(90):
        t = list(first)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(minhash, "NODE", 8)
    part = grouped(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == part


def test_near_duplicates_within_a_family(spark, monkeypatch):
    """Isolated links in a large family of texts that share much are found, however deep the trees go there."""
    rng, words = random.Random(21), vocabulary()
    common, texts = [rng.choice(words) + rng.choice(words) for _ in range(140)], []
    for i in range(300):
        t = common + [f"own{i}x{k}" for k in range(30)]
        texts.append(" ".join(t))
        texts.append(" ".join(t[:-13] + [f"other{i}x{k}" for k in range(13)]))
    rows = list(enumerate(texts))
    part = grouped(rows)
    assert len(rows) - len(set(part.values())) == 300
    monkeypatch.setattr(minhash, "NODE", 3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == part


def test_near_duplicates_at_lower_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 are linked by the pipeline's stage, and not under the contract of op10."""
    import corpus_pipeline

    rng, words = random.Random(12), vocabulary()
    texts = []
    for k in range(20):
        t = [rng.choice(words) + rng.choice(words) for _ in range(100)]
        texts += [" ".join(t), " ".join(t[: 93 - k % 5] + [f"new{k}x{i}" for i in range(7 + k % 5)])]
    like = [len(a & b) / len(a | b) for a, b in zip(map(sets_of, texts[::2]), map(sets_of, texts[1::2]), strict=True)]
    assert sum(0.8 <= x < 0.85 for x in like) == 12 and sum(x < 0.8 for x in like) == 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {i for i in range(40) if i % 2 == 0 or like[i // 2] < 0.8}
    assert minhash.near_duplicates(docs).filter("not kept").count() == sum(x >= 0.85 for x in like)


@pytest.mark.parametrize(("alike", "node"), [(0.75, 300), (0.9, 300), (0.9, 40)])
def test_recall_within_large_nodes(alike, node):
    """Pairs at the threshold within a family of 3000 are found however deep its nodes branch; no pair is linked before."""
    rng, pairs, n = np.random.default_rng(1), 200, 3000
    base = rng.integers(0, 2**32, minhash.TOKENS, dtype=np.uint32)
    other = lambda m, s: np.where(rng.random(m.shape) < s, m, rng.integers(0, 2**32, m.shape, dtype=np.uint32))
    m = other(np.broadcast_to(base, (n, minhash.TOKENS)), alike)
    m = np.concatenate((m, other(m[:pairs], 0.85))).astype(np.uint32)
    trees, found, deepest = minhash._trees(85), np.zeros(pairs, bool), 0
    with np.errstate(over="ignore"):
        for tree in range(trees):
            _, node_of = np.unique(m[:, tree * minhash.TOKENS // trees], return_inverse=True)
            at = np.flatnonzero(node_of == np.bincount(node_of).argmax())
            deep, again = 0, 0
            while again == 0 or again < minhash._repeats(85, deep):
                for depth, leaf in minhash._leaves(m[at], np.arange(len(at)), tree + 1000 * again, False, node):
                    here, deep = np.isin(np.arange(len(m)), at[leaf]), max(deep, depth)
                    found |= here[:pairs] & here[n:]
                again += 1
            deepest = max(deepest, deep)
    assert found.mean() >= 0.99 and deepest >= 5


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 20), (None, 4), (5, None), (2, 1), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (35, 36)]
    out = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.v: r.root for r in out.collect()} == {2: 1, 3: 1, 8: 7, 9: 7, 31: 30, 32: 30, 33: 30, 34: 30, 35: 30, 36: 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# registered queries


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, tmp_path, rows, name):
    """The registered SQL on the fixture (ids unique and known, as in the tables it is written for)."""
    known = list({r[0]: r for r in rows if r[0] is not None}.values())
    spark.createDataFrame(known, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(210, 8)))], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    html = lambda i: f"<html><nav><ul><li>Home {i % 7}</li><li>Home</li></ul></nav><p>{known[i][1] or 'x'}</p><div>tail<br>{i}</div></html>"
    spark.createDataFrame([(i, f"https://www.h{i % 7}.example.org/{i}", html(i)) for i in range(60)] + [(60, None, "<p>a</p>"), (61, "zzz", None)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, str(tmp_path)).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert show(got) == show(want)
