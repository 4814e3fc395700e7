"""Kernels against their plain definitions, without Spark."""

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from acrework.llm import chi_square, pfor
from acrework.llm.common import utf8
from acrework.llm.near_dedup import fingerprints, table_keys
from acrework.llm.packing import hilbert_key
from acrework.llm.quality_rules import statistics
from acrework.llm.rolling import Prefix, sliding_min
from acrework.llm.secrets import RULES, Scanner
from acrework.llm.shingles import shingle_sets
from acrework.llm.suffix_dedup import Runs
from acrework.llm.trigram_query import TRUE, TrigramIndex, WantedTrigrams, trigram_query

TEXT = st.text(alphabet=" \n\tabé1²'streldv!x😀　", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.sampled_from([1, 7, 64, 256]), st.sampled_from([0.0, 50.0, 90.0, 100.0]))
def test_frame_of_reference_round_trip(ids, block, percentile):
    ids = np.asarray(ids, np.uint32)
    data = pfor.encode(ids, block, percentile)
    assert (pfor.decode(data) == ids).all() and len(pfor.decode(data)) == len(ids)


def test_frame_of_reference_reads_a_range_and_is_smaller_with_exceptions():
    ids = np.random.default_rng(1).integers(0, 900, 10_000).astype(np.uint32)
    ids[::40] = 4_000_000_000
    data = pfor.encode(ids)
    assert (pfor.read_range(data, 777, 600) == ids[777:1377]).all()
    assert len(data) < 2.2 * len(ids) < len(pfor.encode(ids, percentile=100))


@pytest.fixture(scope="module")
def merger():
    import public_tokenizers as P

    from acrework.llm.byte_bpe import Merger

    return Merger(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference_bpe():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_byte_bpe_equals_the_library(merger, reference_bpe, texts):
    for text, found in zip(texts, merger.encode_batch(texts)):
        ids = np.frombuffer(b"".join(p[0] for p in found), "<u4").tolist()
        assert ids == reference_bpe.encode_ordinary(text)
        assert ",".join(p[1] for p in found) == ",".join(map(str, ids))
        assert merger.decode(ids) == text.encode()


def test_byte_bpe_long_pieces(merger, reference_bpe):
    for text in ("a" * 5000, "ab" * 300, "thequick" * 300 + "'s", "'ll'm" * 5):
        ids = np.frombuffer(b"".join(p[0] for p in merger.encode_batch([text])[0]), "<u4").tolist()
        assert ids == reference_bpe.encode_ordinary(text)


def ids_of(encoder, texts):
    import pyarrow as pa

    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@cache
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def by_library(texts):
    return [library().encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(st.sampled_from(list("abE1é.,;'-% \n\t漢ß²×\u00a0_")), max_size=40)), max_size=6))
def test_pieces_equal_the_library(texts):
    import public_tokenizers as P

    from acrework.llm.library_bpe import worker_encoder

    assert ids_of(worker_encoder(P.path("byte_bpe_50k.json"), 400_000), texts) == by_library(texts)


def test_pieces_equal_the_library_on_runs_long_pieces_and_nulls():
    import public_tokenizers as P

    from acrework.llm.library_bpe import PieceEncoder

    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghij0123+/"), 4000))
    texts = [None, "", "a", " ", "\n", " " * 50 + "x", "x" + " " * 50, "a\n\n\nb \n c\r\nd", long, long + " " + long, "word." * 400, "漢字かな交じり文" * 60, "don't 'quote' it's'", "naïve café.\nÉté; voilà\u00a0: «ok»"]
    texts += [" ".join(rng.choice(["alpha", "beta,", "gamma.\nDelta", "42", "%%%", "l'été"], 60)) for _ in range(40)]
    small = PieceEncoder(P.path("byte_bpe_50k.json"), 60_000)
    for _ in range(2):  # the second time from the table
        assert ids_of(small, texts) == by_library(texts)
    assert small.table.n and small.table.room >= 0 and ids_of(small, []) == []


def test_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    import public_tokenizers as P

    from acrework.llm import library_bpe

    whole = library_bpe.Prefix.ranges
    monkeypatch.setattr(library_bpe.Prefix, "ranges", lambda self, a, b: whole(self, a, b) & np.uint64(7))
    texts = ["the cat saw a dog and the dog saw a cat.", "a dog saw the other dog, twice the cat"] * 3
    encoder = library_bpe.PieceEncoder(P.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert ids_of(encoder, texts) == by_library(texts)


def test_added_tokens_in_texts_as_by_library():
    import public_tokenizers as P
    from tokenizers import AddedToken, Tokenizer

    from acrework.llm.library_bpe import PieceEncoder

    own, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), PieceEncoder(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one<|endoftext|>two three", "a  <|endoftext|>  b ", "<|endoftext| > a", "plain words a b"]
    expected = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [64, 220, 50256, 275]
    assert ids_of(encoder, texts) == expected
    for t in (own, encoder.tokenizer):
        t.add_tokens([AddedToken("two three", normalized=False)])
    encoder.added.append("two three")
    texts = ["zero two", "zero three four", "one two three four", *(f"x two{i}" for i in range(3))]
    assert ids_of(encoder, texts) == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_trigram_queries_never_miss_and_hex_has_none():
    assert trigram_query(r"[0-9a-f]+") == TRUE
    assert trigram_query("abcd|x") == TRUE
    assert trigram_query("abcd|wxyz")[0] == "or"
    texts = ["nothing", "API-KEY", "ApiKey: abcdefgh12", "x PASSWD='longenough'", "AKIA" + "Z" * 12, "AKIA", "a" * 40, "", "ghp_" + "a1" * 20, "secret = short"]
    data, offsets = utf8(pa.array(texts))
    queries = [trigram_query(r.pattern, r.flags) for r in RULES]
    index = TrigramIndex(data, offsets, WantedTrigrams(queries))
    for rule, query in zip(RULES, queries):
        candidates = set(index.candidates(query).tolist())
        assert {i for i, t in enumerate(texts) if re.search(rule.pattern, t, rule.flags)} <= candidates
    assert set(index.candidates(queries[0]).tolist()) <= {2, 3, 9}


def test_secret_spans_are_leftmost_and_do_not_overlap_within_a_kind():
    found = Scanner(RULES).scan(pa.array(["é secret:token:abcdefgh", "token=abcdefgh password=12345678", None]))
    assert found == [[], [(0, 0, 14), (15, 0, 32)], []]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c\nDé", max_size=60), max_size=5))
def test_shingle_sets_have_the_right_sizes_and_overlaps(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    key, bounds = shingle_sets(data, offsets)

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [set(key[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    expected = [plain(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in expected]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(expected[i] & expected[j])
    marks = fingerprints(key, bounds)
    assert all((marks[i] == marks[j]) == (expected[i] == expected[j]) for i in range(len(texts)) for j in range(i))
    assert table_keys(key, bounds)[0].shape[0] == len(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n#é", max_size=60), max_size=5))
def test_quality_statistics_equal_their_definitions(texts):
    got = statistics(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + d for k, t in enumerate(windows) if windows.count(t) > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected


def test_rolling_hashes_and_sliding_minimum():
    data = np.frombuffer(b"abcabcabcxabc", np.uint8)
    prefix = Prefix(data)
    three = prefix.windows(3)
    assert three[0] == three[3] == three[10] != three[1]
    at = np.array([0, 3, 1])
    same = prefix.ranges(at, at + 4)
    assert same[0] == same[1] != same[2]
    values = np.random.default_rng(0).integers(0, 99, 50)
    assert (sliding_min(values, 7) == [values[i : i + 7].min() for i in range(44)]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), max_size=4), st.integers(1, 4))
def test_repeats_inside_a_document(texts, period):
    texts = [t * 3 + ("xy" * period) * 30 for t in texts]
    data, offsets = utf8(pa.array(texts, pa.string()))
    got = Runs(data, offsets, threshold=20, digit=8).repeated_inside().tolist()
    expected = []
    for t, at in zip(texts, offsets.tolist()):
        seen = set()
        for i in range(len(t) - 19):
            if t[i : i + 20] in seen:
                expected.append(at + i)
            seen.add(t[i : i + 20])
    assert got == expected


def test_hilbert_neighbours_are_one_step_apart_and_keys_unique():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, indexing="ij"), -1).reshape(-1, 2)
    key = hilbert_key(cells, bits=4)
    path = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(256))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_chi_square_values():
    assert chi_square.cdf(3.841459, 1) == pytest.approx(0.95, abs=1e-6)
    assert chi_square.quantile(0.99, 5) == pytest.approx(15.08627, abs=1e-4)


def test_language_model_learns_and_is_undecided_without_letters():
    from acrework.llm import language_id as L

    rows = [("the thing and that " * 5, "en"), ("der die und das ist " * 5, "de")] * 20
    frequency = np.zeros(L.BUCKETS, np.int64)
    for text, _ in rows:
        frequency[L.counts(text)[0]] += 1
    model = L.fit_model(rows, frequency, len(rows))
    label, score = model.predict(["that and the", "und der das", None, "123 !!", ""])
    assert label == ["en", "de", "und", "und", "und"]
    assert (score[:2] > 0.5).all() and (score[2:] == 0).all()
    assert (model.weights == 0).mean() > 0.5  # the penalty keeps weights sparse
    assert L.fit_model([], frequency, 0).predict(["abc"])[0] == ["und"]


def test_network_gradients_and_learning():
    from acrework.llm import toxicity as T

    net = T.Network({"idiot": 1, "the": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y = ["the idiot of a thing " * 3, "hello the world", "a " * 50 + "idiot the end"], np.array([1, 0, 1])

    def loss():
        batch = T.Batch(texts)
        z, _ = net.document_logits(net.window_logits(batch), batch)
        p = T._sigmoid(z)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(texts, y)
    for name in ("word", "gram", "into", "bias", "turn", "look", "out", "base"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        high = loss()
        net.p[name][at] = old - step
        low = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((high - low) / (2 * step), rel=0.05, abs=1e-4)
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "in"]
    rows = []
    for i in range(120):
        w = list(rng.choice(words, 60))
        if i % 2:
            w[int(rng.integers(60))] = "blorked"
        rows.append((" ".join(w), i % 2))
    fitted = T.fit_network(rows, steps=150)
    s = fitted.scores(["alpha beta " * 200 + "blorked gamma", "alpha beta gamma " * 30, "", None])
    assert s[0] > 0.5 > s[1] and s[2] == s[3] and 0 <= s[2] <= 1


def test_repeats_inside_a_text_whatever_the_hashes(monkeypatch):
    from acrework.llm import suffix_dedup

    rng = np.random.default_rng(12)
    part = "".join(rng.choice(list("abcd"), 150))
    texts = [part + "x" + part[:130] + "y" + part[20:], "ab" * 200, part, "z" * 130]
    data, offsets = utf8(pa.array(texts))
    expected, at = [], 0
    for t in texts:
        seen = set()
        for i in range(len(t) - 99):
            expected += [at + i] if t[i : i + 100] in seen else []
            seen.add(t[i : i + 100])
        at += len(t)
    assert sorted(suffix_dedup.Runs(data, offsets).repeated_inside().tolist()) == expected
    whole = suffix_dedup.Prefix.ranges
    monkeypatch.setattr(suffix_dedup.Prefix, "ranges", lambda self, a, b: whole(self, a, b) & np.uint64(3))
    assert sorted(suffix_dedup.Runs(data, offsets, digit_bits=4).repeated_inside().tolist()) == expected


def test_anchors_do_not_depend_on_the_slice():
    from acrework.llm import suffix_dedup

    text = np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8).tobytes().decode() + "q" * 900
    alone = suffix_dedup.Runs(*utf8(pa.array([text])))
    among = suffix_dedup.Runs(*utf8(pa.array(["other text " * 40_000, text, "more"])))
    own = among.doc == 1
    assert (among.digit[own] == alone.digit).all() and (among.left[own] == alone.left).all() and (among.size[own] == alone.size).all()
    place, suffix_dedup.PLACE_BITS = suffix_dedup.PLACE_BITS, 10  # many blocks of one text
    try:
        blocks = suffix_dedup.Runs(*utf8(pa.array([text])))
    finally:
        suffix_dedup.PLACE_BITS = place
    assert (blocks.start[1:] > blocks.start[:-1]).all() and blocks.size.sum() == alone.size.sum()
