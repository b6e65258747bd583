import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from basetrack.llm import exact_dedup, kneser_ney, mixing, ngram_join, packing, repetition
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_measures(text):
    own, seen, lines = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    inside = {j for i in range(len(own) - 4) if grams[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(inside)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|\x0b　", max_size=80)), min_size=1, max_size=8))
def test_repetition_measures_equal_brute_force(texts):
    m = repetition.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert tuple(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_measures(text)


def test_repetition_rows(docs, no_docs):
    out = {(r.doc_id, i): r for i, r in enumerate(repetition.repetition(docs).collect())}
    assert len(out) == 13
    by_id = {r.doc_id: r for r in out.values()}
    assert by_id[4].n_words == 0 and by_id[4].base_failed and not by_id[4].kept
    assert by_id[1].kept and not by_id[9].kept
    assert repetition.repetition(no_docs).count() == 0


def brute_links(rows, n=5, threshold=0.8):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return links, [root(i) for i in range(len(rows))]


def test_join_equals_brute_force(spark):
    g = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        base = [f"v{x}" for x in g.integers(0, 5000, g.integers(3, 120))]
        for _ in range(int(g.integers(1, 5))):
            own = list(base)
            for _ in range(int(g.integers(0, 4))):
                own[int(g.integers(0, len(own)))] = "changed"
            rows.append((len(rows), " ".join(own)))
    links, roots = brute_links(rows)
    out = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_links for i in range(len(rows))] == links
    assert [out[i].class_id for i in range(len(rows))] == roots


def test_large_groups_go_in_tiles(spark, monkeypatch):
    for name in ("TILE", "GROUP", "BLOCK", "ROWS", "STEP"):
        monkeypatch.setattr(ngram_join, name, 8)
    base = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join([*base[:i], f"other{i}", *base[i + 1 :]])) for i in range(40)]
    links, roots = brute_links(rows)
    out = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(out[i].n_links, out[i].class_id) for i in range(40)] == list(zip(links, roots, strict=True))


def test_join_edge_cases(docs, no_docs):
    out = ngram_join.near_duplicates(docs).collect()
    assert len(out) == 13
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].class_id == by_id[2].class_id == by_id[3].class_id == 1 and by_id[3].n_links == 2
    assert by_id[4].n_links == by_id[5].n_links == by_id[10].n_links == 0
    assert by_id[8].n_links == 2 and by_id[8].class_id == 7
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_first_of_groups(docs, no_docs):
    kept = ngram_join.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 7, 9, 10, 11, 12]
    assert ngram_join.first_of_groups(no_docs).count() == 0


def test_bands_reach_the_recall():
    rules = ngram_join.JoinRules()
    b, r = rules.bands()
    assert b * r <= rules.most_hashes and 1 - (1 - rules.threshold**r) ** b >= rules.recall


def test_exact_duplicates(docs, no_docs):
    out = exact_dedup.duplicates(docs).collect()
    assert len(out) == 13
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for r in out:
        ids = digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.duplicates(no_docs).count() == 0


def test_busy_owners_are_looked_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 4)
    least = -(2**63)
    rows = [(i % 50, "copied") for i in range(120)] + [(i, f"alone {i}") for i in range(30)] + [(None, "null"), (least, "null"), (None, "nulls"), (None, "nulls")]
    out = exact_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.text_sha256].append(r)
    own = {t: by[hashlib.sha256(t.encode()).hexdigest()] for _, t in rows}
    assert len(out) == len(rows) and all(sum(r.kept for r in v) == 1 for v in own.values())
    assert {(r.keep_id, r.group_size) for r in own["copied"]} == {(49, 120)} and [r.doc_id for r in own["copied"] if r.kept] == [49]
    assert {(r.keep_id, r.group_size) for r in own["null"]} == {(least, 2)} and [r.doc_id for r in own["null"] if r.kept] == [least]
    assert {(r.keep_id, r.group_size) for r in own["nulls"]} == {(None, 2)} and {r.group_size for t, v in own.items() if t.startswith("alone") for r in v} == {1}


def test_survivors_keep_all_columns(docs, no_docs):
    out = exact_dedup.survivors(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 3, 5, 8, 9, 10, 11, 12]
    assert exact_dedup.survivors(no_docs).count() == 0


def test_directory_splits_and_doubles():
    d = exact_dedup.Directory(0, capacity=4)
    keys = sorted(int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8]) for i in range(200))
    given = []
    for k in keys:
        d.insert(k, [k])
        for b in list(d.before(k)):
            given += [x for x, _ in b["entries"]]
            assert len(b["entries"]) <= 4
            b["entries"] = []
    given += [x for b in d.rest() for x, _ in b["entries"]]
    assert given == keys and d.doublings >= 5


def test_chains_compare_bytes(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["p", "q", "p", "r", "q", "p"])]
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(7).cast("long"))  # every text collides
    out = exact_dedup.build_index(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.keep_id, r.group_size) for r in out) == [(3, 1), (4, 2), (5, 3)] and {r.chain for r in out} == {0, 1, 2}


def test_packing_places_every_id_once(docs, no_docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack_documents(docs).collect()
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for runs in sequences.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for r in docs.where("doc_id <> 7").collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, p in enumerate(sorted(by_doc[r.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and zlib.crc32(ids[at : at + p.length]) == p.ids_crc32
            assert k == 0 or p.length == packing.CAPACITY
            at += p.length
        assert at == len(ids)
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,'\n |<>1日 \r\t", max_size=40), min_size=1, max_size=5))
def test_cut_texts_have_the_same_ids(texts):
    encoder = packing.Encoder(packing.default_tokenizer())
    ids, counts = encoder.encode(pa.array(texts))
    assert np.split(ids, np.cumsum(counts)[:-1]) is not None
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_best_fit_plan(counts):
    plan, used = packing.best_fit(counts, 64)
    filled = collections.defaultdict(list)
    ranks = collections.defaultdict(set)
    for length, rank, n, sequence, offset in plan:
        for i in range(n):
            filled[sequence + i].append((offset, length))
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
    assert {k: len(v) for k, v in ranks.items()} == counts and set(filled) == set(range(used))
    for runs in filled.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 64


def test_mixing_budgets(spark, no_docs):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small") for i in range(4000)] + [(9000, None, None), (9001, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as blocks", "'x' as rest", "2 as key", "3 as tokens")
    mixed = mixing.mix_sources(docs, mixing.Mix(max_repeats=3.0, block_rows=64))
    assert mixed.columns[:7] == docs.columns
    out = mixed.collect()
    tokens = collections.Counter()
    times = collections.Counter()
    have = collections.Counter()
    for _, text, source in rows:
        have[source] += len(words(text))
    for r in out:
        tokens[r.source] += r.mix_tokens
        times[r.doc_id] += 1
    assert min(times[i] for i, *_ in rows) >= 1  # nothing is lost
    assert max(times.values()) <= 4
    most = max(tokens[s] / have[s] for s in have)
    assert 2.9 < most <= 3.0 + 1e-9 and min(tokens[s] / have[s] for s in have) >= 1 - 0.01
    assert mixing.mix_sources(no_docs).count() == 0


def test_mixing_entropy_and_budget(spark):
    rows = [(i, "w w", "abc"[min(i % 10, 2)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, mixing.Mix(target_entropy=1.0, budget=3000)).groupBy("source").sum("mix_tokens").collect()
    shares = np.array([r[1] for r in out]) / sum(r[1] for r in out)
    assert abs(-(shares * np.log(shares)).sum() - 1.0) < 0.02 and abs(sum(r[1] for r in out) - 3000) < 50


def test_kneser_ney_sums_to_one(spark, tmp_path):
    texts = ["abcabcabd", "abdabc", "aab\n"]
    docs = spark.createDataFrame([(0, t) for t in texts], "lang_id int, text string")
    folder = f"file://{tmp_path}"
    place = kneser_ney.write_shards(kneser_ney.model(kneser_ney.count_ngrams(docs), folder), folder)
    shards = kneser_ney.Shards(place)
    for context in (b"\n\n\n\n", b"abca", b"zzzz", b"\nabd"):
        grams = np.array([int.from_bytes(context + bytes([c])) for c in range(256)])
        logs = kneser_ney.log_probabilities(np.zeros(256, np.int64), grams, shards)
        assert abs(np.exp(logs).sum() - 1) < 1e-6


def test_perplexity_filter_rows(spark, docs, no_docs):
    ids = docs.select("doc_id")
    out = kneser_ney.perplexity_filter(docs, ids).collect()
    assert len(out) == 13
    by_id = {r.doc_id: r for r in out}
    assert by_id[4].perplexity is None and not by_id[4].kept and not by_id[5].kept and by_id[1].kept
    assert kneser_ney.perplexity_filter(no_docs, ids).count() == 0


def test_packed_ngrams_begin_after_breaks():
    data = np.frombuffer(b"xyz", np.uint8)
    assert kneser_ney.packed(data, np.array([0, 1, 3])).tolist() == [int.from_bytes(b"\n\n\n\nx"), int.from_bytes(b"\n\n\n\ny"), int.from_bytes(b"\n\n\nyz")]


def test_hot_group_of_copies(spark):
    rows = [(i, "same text of many" if i % 3 == 0 else f"text {i} of one") for i in range(3000)]
    out = exact_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("group_size > 1")
    assert out.count() == 1000 and out.where("kept").collect()[0].doc_id == 2997


@pytest.mark.parametrize("length,starts", [(1, [0]), (2048, [0]), (2049, [0, 1]), (4096, [0, 2048]), (5000, [0, 904, 2952])])
def test_piece_starts(length, starts):
    assert packing.piece_starts(length) == starts


def two_unlike_words(n=1024):
    """Two different strings on which any polynomial modulo 2^64 collides."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_unlike_words_and_lines_stay_apart(spark):
    one, other = two_unlike_words()
    m = repetition.measure(pa.array([f"{one}\n{other}", f"{one}\n{one}"]))
    assert m["n_dup_lines"].tolist() == [0, 1]
    rows = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert [(r.class_id, r.n_links) for r in ngram_join.near_duplicates(rows).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]


def test_cached_cuts_are_compared_by_their_bytes(monkeypatch):
    texts = ["one two three", "four two " + "x" * 100, "five two " + "y" * 100, *two_unlike_words()]
    alone = packing.Encoder(packing.default_tokenizer()).tokenizer
    want = [alone.encode(t, add_special_tokens=False).ids for t in texts]
    for same in (False, True):
        if same:  # all cuts collide
            monkeypatch.setattr(packing.tx, "byte_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        encoder = packing.Encoder(packing.default_tokenizer())
        for _ in range(2):
            ids, n = encoder.encode(pa.array(texts))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_repeats_are_exact_where_all_hashes_collide(monkeypatch):
    texts = ["a b c d e f a b c d e x a b c d e\na\nb\na", "one two three four five six seven"]
    want = repetition.measure(pa.array(texts))
    monkeypatch.setattr(repetition.tx, "keyed", lambda hashes, rows: np.zeros(len(hashes), np.uint64))
    got = repetition.measure(pa.array(texts))
    assert all(np.array_equal(want[k], got[k]) for k in want) and [base_measures(t)[3:] for t in texts] == list(zip(got["n_dup_lines"].tolist(), got["n_repeat_words"].tolist(), strict=True))


def brute_verdict(text, rules=repetition.RepetitionRules()):
    """kept, by plain counting."""
    own, (n, chars, _, dup_lines, repeats) = words(text), base_measures(text)
    if n < 10 or 100 * repeats > 20 * n:
        return False

    def share(k, least):
        grams = collections.Counter(tuple(own[i : i + k]) for i in range(n - k + 1))
        inside = {j for i in range(n - k + 1) if grams[tuple(own[i : i + k])] >= least for j in range(i, i + k)}
        return sum(len(own[j]) for j in inside) / chars

    for k, limit in rules.duplicate_ngrams:
        if share(k, 2 if k <= 5 else 3) > limit:
            return False
    for k, limit in rules.top_ngrams:
        grams = collections.Counter(tuple(own[i : i + k]) for i in range(n - k + 1))
        if any(c >= 4 and c * sum(map(len, g)) / chars > limit for g, c in grams.items()):
            return False
    lines = [x for x in text.split("\n") if words(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    return not (dup_lines >= 3 and (dup_lines / len(lines) > 0.30 or sum(map(len, again)) / len(text) > 0.20))


def test_verdicts_equal_brute_force():
    g = np.random.default_rng(8)
    texts = []
    for _ in range(400):
        own = [f"w{x}" for x in g.integers(0, int(g.choice([6, 40, 400])), int(g.integers(5, 200)))]
        for _ in range(int(g.integers(0, 4))):  # a passage that comes again
            at, k, to = int(g.integers(0, len(own))), int(g.integers(2, 14)), int(g.integers(0, len(own)))
            own[to:to] = own[at : at + k]
        texts.append("".join(w + ("\n" if g.random() < 0.1 else " ") for w in own))
    got = repetition.measure(pa.array(texts))["kept"].tolist()
    assert got == [brute_verdict(t) for t in texts] and 20 < sum(got) < 380


def test_large_sets_go_by_differences(spark, monkeypatch):
    """Groups beyond the limits of bytes, chained so that the base is unlike most of the group."""
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", 1 << 10)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 1 << 10)
    base = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(base[6 * i : 6 * i + 200])) for i in range(30)] + [(100 + i, " ".join([*base[:150], f"x{i}", *base[150:200]])) for i in range(9)]
    links, roots = brute_links(rows)
    out = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(out[i].n_links, out[i].class_id) for i, _ in rows] == [(n, rows[r][0]) for n, r in zip(links, roots, strict=True)]


def test_hubs_are_joined_by_broadcast(spark, tmp_path, monkeypatch):
    from basetrack.llm import common
    from basetrack.llm.components import components

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 340)] + [(7, 300), (500, 501), (9, 9)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}").collect()}
    assert out == {**{i: 0 for i in (*range(200), *range(300, 341))}, 500: 500, 501: 500}


def test_columns_of_any_name_stay(spark, tmp_path):
    import corpus_pipeline

    names = "score toxicity_score n_windows mix_tokens mix_key mix_epoch key lost _basetrack_key k0 c0 row got length"
    rows = [(i, f"text number {i} of these", "s", *[str(i)] * len(names.split())) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names.split()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} == set(rows), name
    mixed = mixing.mix_sources(docs)
    assert mixed.columns[-6:] == ["mix_epoch_1", "mix_block", "mix_block_order", "mix_row_order", "mix_tokens_1", "mix_weight"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 12


def plain_kneser_ney(trusted, order=5):
    """Interpolated modified Kneser-Ney over bytes, by plain dictionaries: the probability of a byte after its history."""
    top = collections.Counter()
    for text in trusted:
        data = b"\n" * (order - 1) + text.encode()
        top.update(data[i : i + order] for i in range(len(data) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, own in counts.items():
        n = [sum(c == i for c in own.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5, 0.05), i) for i in (1, 2, 3)]
        d = [max(min(x, float(i)), 0.05) for i, x in zip((1, 2, 3), d, strict=True)]
        total, freed = collections.Counter(), collections.Counter()
        for g, c in own.items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        tables[k] = own, d, total, freed

    def p(gram):
        if not gram:
            return 1 / 256
        own, d, total, freed = tables[len(gram)]
        lower = p(gram[1:])
        if not total[gram[:-1]]:
            return lower
        c = own[gram]
        return ((c - d[min(c, 3) - 1]) if c else 0) / total[gram[:-1]] + freed[gram[:-1]] / total[gram[:-1]] * lower

    def perplexity(text):
        data = b"\n" * (order - 1) + text.encode()
        logs = [np.log(p(data[i : i + order])) for i in range(len(data) - order + 1)]
        return float(np.exp(-sum(logs) / len(logs)))

    return perplexity


def test_perplexities_equal_plain_kneser_ney(spark, monkeypatch):
    import zlib

    monkeypatch.setattr(kneser_ney, "SHARD_ROWS", 300)
    monkeypatch.setattr(kneser_ney, "HELD_ROWS", 700)  # some shards are held, others read again
    g = np.random.default_rng(2)
    rows = [(i, ["en", "de", None][i % 3], " ".join("abcdé"[int(x) : int(x) + 3] for x in g.integers(0, 4, int(g.integers(1, 40))))) for i in range(90)]
    trusted = [i for i in range(90) if i % 4]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = {r.doc_id: r for r in kneser_ney.perplexity_filter(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), kneser_ney.Quantiles(least_held=2)).collect()}
    held = {i for i in trusted if zlib.crc32(f"held|{i}".encode()) % 5 == 0}
    for lang in ("en", "de", None):
        perplexity = plain_kneser_ney([t for i, l, t in rows if l == lang and i in trusted and i not in held])
        own = [(i, t) for i, l, t in rows if l == lang]
        assert all(abs(out[i].perplexity - perplexity(t)) < 1e-9 * out[i].perplexity for i, t in own)
        low, high = min(out[i].perplexity for i, _ in own if i in trusted), max(out[i].perplexity for i, _ in own if i in held)
        assert all(out[i].low == low / 1.1 and out[i].high == high * 1.1 for i, _ in own)
        assert all(out[i].kept == (out[i].low <= out[i].perplexity <= out[i].high) for i, _ in own)
