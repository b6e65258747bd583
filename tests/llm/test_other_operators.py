import base64
import hashlib
import io

import numpy as np
import pyarrow as pa
import pytest
from basetrack.llm import chat, toxicity, url_reputation, warc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same", "x"), (2, None, "same", "x"), (3, "u\r\nv%0A", "é" * 200_000, "x"), (4, "", None, "x"), (5, "b", "", "x"), (None, "c", "other", "x"), (2, None, "same", "x")]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == len(rows)
    by = {(r.page_id, r.payload_bytes): r for r in out}
    want = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for i, url, html, _ in rows:
        r = by[i, len((html or "").encode())]
        assert r.payload_digest == want(html) and r.target_uri == url
    assert (by[1, 4].record_type, by[1, 4].refers_to) == ("revisit", 2) and by[2, 4].record_type == "response"
    assert (by[4, 0].record_type, by[4, 0].refers_to) == ("revisit", 5)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_long_urls(spark):
    urls = {1: "data:," + "é%\r\n\r\n" * 700_000, 2: "http://a/?" + "q" * (64 << 10), 3: "http://b/", 4: "http://c/?" + "r" * (20 << 20)}
    out = warc.round_trip(spark.createDataFrame([(i, url, "same" if i < 3 else f"text {i}", "x") for i, url in urls.items()], PAGES)).collect()
    assert {r.page_id: r.target_uri for r in out} == urls and len(out) == 4


def test_small_payloads_are_responses(spark):
    rows = [(1, "a", "same", ""), (2, "b", "same", "")]
    assert {r.record_type for r in warc.round_trip(spark.createDataFrame(rows, PAGES), 5).collect()} == {"response"}


def test_reader_finds_damage():
    good = warc.record(1, "u", b"payload", None, False)
    assert [r[:2] for r in warc.read_archive(io.BytesIO(good + good))] == [(1, "response")] * 2
    with pytest.raises(Exception):
        list(warc.read_archive(io.BytesIO(good[:-9])))
    import zlib

    raw = zlib.decompress(good, 31).replace(b"payload", b"pAyload")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_archive(io.BytesIO(z.compress(raw) + z.flush())))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="us\n\\<|", max_size=6), st.text(alphabet="<|\\imx_end>\n", max_size=40)), max_size=4))
def test_template_is_reversible(turns):
    import re

    esc = lambda t: re.sub(r"<(\\*)\|", r"<\1\\|", t)
    piece = "".join(f"{chat.BEGIN}{esc(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{esc(text)}{chat.END}\n" for role, text in turns)
    assert chat.parse(piece) == turns


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_events_fold_into_messages(spark):
    rows = [
        (1, 0, "message", 0, "user", "hi <|im_end|>"), (1, 1, "delta", 1, "assistant", "he"), (1, 2, "delta", 1, "assistant", "llo"), (1, 3, "regenerate", 1, None, None), (1, 4, "delta", 1, None, "bye"),
        (1, 5, "edit", 0, None, "hey"), (1, 6, "message", 2, "user", "gone"), (1, 7, "delete", 2, None, None), (None, 0, "message", 0, None, None), (2, 5, "delta", 9, "assistant", "a"), (2, 6, "delta", 9, "assistant", None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message_id long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(events))).collect()}
    assert out[1].turns_sha256 == digest([("user", "hey"), ("assistant", "bye")]) and out[1].loss_chars == 3
    assert out[1].loss_sha256 == hashlib.sha256(b"bye").hexdigest()
    assert out[None].turns_sha256 == digest([("", "")]) and out[2].turns_sha256 == digest([("assistant", "a")])
    assert chat.read_back(chat.render(chat.fold(events.limit(0)))).count() == 0


def test_repeated_turns_are_turns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (1, None, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.render(chat.fold(chat.as_events(table)))).collect()
    assert out[0].n_turns == 4


def test_rules_and_hosts(spark):
    urls = ["http://Ex.Example.NET/en/x?q", "https://a.net/", "x://example.com/de/a#b", "http://example.com?x", "http://b.org/fr/", None, "nothing", "http://net/", "http://bnet.com/", "http://example.net"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    out = {r.page_id: r for r in url_reputation.judge(pages, none).collect()}
    assert [out[i].rule for i in range(10)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, "net/", None, None]
    assert (out[0].host, out[0].path) == ("ex.example.net", "/en/x") and (out[3].host, out[3].path) == ("example.com", "") and (out[5].host, out[6].path) == ("", "")
    assert out[3].verdict == "allow" and out[1].verdict == "block"
    assert url_reputation.judge(pages.limit(0), none).count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}{i % 6}.example.org/{i}") for i in range(600)]
    outcomes = [(i, i % 2) for i in range(0, 600)] + [(5, None), (None, 1)]
    out = url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"))
    assert {(r.host[:3], r.verdict) for r in out.collect()} == {("bad", "block"), ("goo", "allow")}


@pytest.fixture(scope="module")
def toxic_rows():
    g = np.random.default_rng(3)
    syllables = ["ta", "lo", "mi", "ren", "so", "ku", "ba", "ne"]
    rows = []
    for i in range(900):
        text = ["".join(g.choice(syllables, g.integers(1, 4))) for _ in range(int(g.integers(5, 120)))]
        label = int(i % 3 == 0)
        if label:
            for _ in range(2):
                text[int(g.integers(0, len(text)))] = str(g.choice(["zzidiot", "zzmoron", "vexu" + str(g.choice(syllables))]))
        rows.append((i, " ".join(text), label))
    return rows


def test_toxicity_held_out(spark, toxic_rows):
    docs = spark.createDataFrame([r[:2] for r in toxic_rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in toxic_rows], "doc_id long, toxic int")
    net = toxicity.Net(sample=150)
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(labels["doc_id"])), net)
    out = toxicity.score(docs, model, net).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    truth = {r[0]: r[2] for r in toxic_rows}
    right = [(r.score >= 0.5) == truth[r.doc_id] for r in out]
    assert len(out) > 100 and np.mean(right) > 0.9


def test_toxicity_edge_cases(spark, docs, no_docs, toxic_rows):
    p = toxicity.train([r[1] for r in toxic_rows[:200]], [r[2] for r in toxic_rows[:200]], toxicity.Net())
    others = tuple(c for c in docs.columns if c != "doc_id")
    out = toxicity.score(docs, p, keep=others)
    assert out.columns == ["doc_id", *others, "score_1", "n_windows"]
    assert out.count() == 13 and all(0 <= r.score_1 <= 1 and r.score == (None if r.doc_id == 4 else "s") for r in out.collect())
    assert toxicity.score(no_docs, p).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) == 0.0


def test_windows_cover_all_words():
    net = toxicity.Net()
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        at, length, _ = toxicity.windows(np.array([0, n]), net)
        seen = set()
        for a, k in zip(at, length, strict=True):
            seen |= set(range(a, a + k))
        assert seen == set(range(n)) and (length <= net.window).all()


def test_gradients_equal_differences():
    import dataclasses

    net = dataclasses.replace(toxicity.Net(), word_dim=2, char_dim=3, char_hidden=3, hidden=4, window=6, stride=3)
    p = toxicity.start(net) | {"word": np.random.default_rng(0).standard_normal((3, 2)).astype(np.float32)}
    scorer = toxicity.Scorer(p, net)
    s = scorer.prepare(pa.array(["the words of this one follow and more follow them now", "", "short one"]))
    ids, mask = scorer.ids(s, np.arange(len(s["at"])))
    bucket = np.arange(len(s["lo"])) % 3
    y = (np.arange(len(s["at"])) % 2).astype(np.float32)
    at = lambda q: toxicity.loss_gradients(q, ids, mask, (s["data"], s["lo"], s["hi"], bucket), y, np.ones(len(y)), net)
    _, g = at(p)
    for name in set(p) - {"word"}:
        k = int(np.abs(g[name]).argmax())
        up, down = dict(p), dict(p)
        up[name], down[name] = p[name].copy(), p[name].copy()
        up[name].ravel()[k] += 1e-2
        down[name].ravel()[k] -= 1e-2
        assert abs((at(up)[0] - at(down)[0]) / 2e-2 - g[name].ravel()[k]) < 2e-3, name


def test_every_window_is_scored():
    first, length, row = toxicity.windows(np.array([0, 48, 58, 58, 158]), toxicity.Net())
    assert [first[row == i].tolist() for i in range(4)] == [list(range(17)), [48], [], list(range(58, 127))]
    assert [length[row == i].tolist() for i in range(4)] == [[32] * 17, [10], [], [32] * 69]


def test_suffixes_of_two_labels_and_numeric_hosts(spark):
    hosts = {
        "a.org.uk": ("a.org.uk", "org.uk"), "x.b.org.uk": ("b.org.uk", "org.uk"), "www.c.co.nz": ("c.co.nz", "co.nz"), "d.com.cn": ("d.com.cn", "com.cn"), "e.co.in": ("e.co.in", "co.in"),
        "f.example.com": ("example.com", "com"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "11.0.0.1:8080": ("11.0.0.1:8080", "11.0.0.1:8080"), "": ("", ""),
    }
    domain, suffix = url_reputation.levels(F.col("host"))
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: (r.domain, r.suffix) for r in df.select("host", domain.alias("domain"), suffix.alias("suffix")).collect()} == hosts
    domain, suffix = url_reputation.levels(F.col("host"), ("example.com",))
    assert [(r.d, r.s) for r in df.where("host = 'f.example.com'").select(domain.alias("d"), suffix.alias("s")).collect()] == [("f.example.com", "example.com")]


def plain_logit(p, x):
    """One window by plain loops; x: the inputs of its words."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def run(rows, w, u, b):
        h = u.shape[0]
        state, out = np.zeros(h), []
        for row in rows:
            gates = row @ w + b
            z, r = sigmoid(gates[:h] + state @ u[:, :h]), sigmoid(gates[h : 2 * h] + state @ u[:, h : 2 * h])
            c = np.tanh(gates[2 * h :] + (r * state) @ u[:, 2 * h :])
            state = (1 - z) * state + z * c
            out.append(state)
        return out

    states = [np.concatenate(s) for s in zip(run(x, p["wf"], p["uf"], p["bf"]), run(x[::-1], p["wb"], p["ub"], p["bb"])[::-1], strict=True)]
    e = np.exp([float((np.tanh(s @ p["aw"] + p["ab"]) @ p["av"])[0]) for s in states])
    return float((sum(a * s for a, s in zip(e / e.sum(), states, strict=True)) @ p["ow"])[0] + p["ob"][0])


@pytest.mark.parametrize("starts", [7, 1024])
def test_all_windows_equal_plain_loops(monkeypatch, starts):
    monkeypatch.setattr(toxicity, "SWEEP_STARTS", starts)
    net = toxicity.Net(window=6)
    g = np.random.default_rng(4)
    p = {k: v + g.standard_normal(v.shape).astype(np.float32) * np.float32(0.3) for k, v in toxicity.start(net).items()} | {"word": g.standard_normal((1, net.word_dim)).astype(np.float32)}
    scorer = toxicity.Scorer(p, net)
    texts = ["a few words", " ".join(f"w{i % 7}{'x' * (i % 5)}" for i in range(30)), "", "one two three four five six", " ".join(f"v{i}" for i in range(9))]
    s = scorer.prepare(pa.array(texts))
    got = scorer.logits(s)
    ends, _ = toxicity.char_states(p, s["data"], s["lo"], s["hi"], net)
    x = np.concatenate([p["word"][s["bucket"]], ends], 1)[s["which"]]
    want = [plain_logit(p, x[a : a + n]) for a, n in zip(s["at"], s["length"], strict=True)]
    assert len(want) == 1 + 25 + 1 + 4 and np.allclose(got, want, atol=1e-4)


@pytest.mark.parametrize("wide", [True, False])
def test_windows_by_tangents_and_by_exponentials(monkeypatch, wide):
    """Where tangents are slow, whole windows and letters take none of them; both ways equal plain loops, also where gates are far out."""
    monkeypatch.setattr(toxicity, "BY_TANH", wide)
    net = toxicity.Net(window=6)
    g = np.random.default_rng(5)
    p = {k: v + g.standard_normal(v.shape).astype(np.float32) * np.float32(0.3) for k, v in toxicity.start(net).items()} | {"word": g.standard_normal((1, net.word_dim)).astype(np.float32)}
    p["bf"][:3], p["cbb"][3:6] = (200, -200, 50), (-150, 150, 80)
    scorer = toxicity.Scorer(p, net)
    s = scorer.prepare(pa.array([" ".join(f"w{i % 9}{'x' * (i % 17)}" for i in range(40)), "é ö ü ß a b c d"]))
    ends, _ = toxicity.char_states(p, s["data"], s["lo"], s["hi"], net)
    x = np.concatenate([p["word"][s["bucket"]], ends], 1)[s["which"]]
    with np.errstate(over="ignore"):
        want = [plain_logit(p, x[a : a + n]) for a, n in zip(s["at"], s["length"], strict=True)]
    took, tanh = [], np.tanh
    monkeypatch.setattr(np, "tanh", lambda *a, **k: took.append(1) or tanh(*a, **k))
    with np.errstate(all="raise", under="ignore"):
        got = scorer.logits(s)
    assert bool(took) == wide and (s["length"] == 6).all() and np.allclose(got, want, atol=1e-4)


def test_marks_at_the_ends_of_words():
    words = ["((((((deep))))))", "..", ".", "'a'", "-x", "y!?", "[[[[]]]]", "a.b", "(q", "Q)", '"Said,"', "....z"]
    data, lo, hi, bounds = toxicity.tokens(pa.array([" ".join(words), "", "..."]), toxicity.Net())

    def plain(w):
        for _ in range(4):
            w = w[1:] if len(w) > 1 and not w[0].isalnum() else w
            w = w[:-1] if len(w) > 1 and not w[-1].isalnum() else w
        return w.lower()

    assert [bytes(data[a:b]).decode() for a, b in zip(lo, hi, strict=True)] == [plain(w) for w in [*words, "..."]] and bounds.tolist() == [0, len(words), len(words), len(words) + 1]


def test_gates_of_a_place_are_one_run():
    """Each place's gates are read as one run of numbers, and every whole window finds its word there."""
    net = toxicity.Net(window=4)
    p = toxicity.start(net)
    g = np.random.default_rng(6)
    inputs = tuple(g.standard_normal((9, 3 * net.hidden)).astype(np.float32) for _ in range(2))
    sweep, which = toxicity.Sweep(p, inputs, net.window), g.integers(0, 9, 48)
    places = sweep._gates(1, which, np.empty(3 * net.hidden * 48 + net.window, np.float32))
    assert len(places) == net.window and all(x.flags.c_contiguous for pair in places for x in pair)
    want = sweep.gates[1][which].T
    for i, pair in enumerate(places):
        assert (np.concatenate(pair)[:, : 48 - i] == want[:, i:]).all()
