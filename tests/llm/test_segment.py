"""Segmentation: N best against all segmentations, exact round trips, and the model file's own pieces."""

import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pytest

from rankweave.llm import segment

PIECES = [" ", "a", "b", " a", "ab", "ba", " ab", "aba", "bab", "  ", " b", "c", "é"]


@pytest.fixture(scope="module")
def small():
    rng = random.Random(7)
    return segment.vocabulary([(p, i, -rng.uniform(0.5, 4)) for i, p in enumerate(PIECES)], list(range(100, 356)), -6.0)


@pytest.fixture(scope="module")
def real():
    return segment.load()


def every(v, text):
    """All segmentations of a text as (score, ids)."""
    def parse(rest):
        if not rest:
            yield 0.0, ()
            return
        if rest[0] not in v.pieces:
            raw = rest[0].encode()
            for score, ids in parse(rest[1:]):
                yield score + v.byte_score * len(raw), (*[v.bytes_[b] for b in raw], *ids)
        for n in range(1, len(rest) + 1):
            if rest[:n] in v.pieces:
                number, own = v.pieces[rest[:n]]
                for score, ids in parse(rest[n:]):
                    yield score + own, (number, *ids)
    return sorted(parse(" " + text), key=lambda x: -x[0])


def test_n_best_against_all(small):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("aab  b\nc") for _ in range(rng.randint(1, 11)))
        want = every(small, text)
        for n in (1, 3, 6):
            got = segment.nbest(small, text, n)
            assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:n]])
            assert len({tuple(ids) for _, ids in got}) == len(got)
            known = {ids: s for s, ids in want}
            assert all(known[tuple(ids)] == pytest.approx(s) for s, ids in got)


def test_a_star_yields_all_in_order(small):
    for text in ("abab", "babab", " aba"):
        got = list(segment.a_star(small, text))
        want = [s for s, _ in every(small, text[1:])] if text[0] == " " else None
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
        assert want is None or [s for s, _ in got] == pytest.approx(want)
        best, score, gap = next(segment.solve(small, [text]))
        assert best == got[0][1] and score == pytest.approx(got[0][0])
        assert gap == pytest.approx(got[0][0] - got[1][0])


def test_round_trips(real):
    rng = random.Random(3)
    alphabet = "ab é☃😀▁\n\r\t  \u0000ß,.!X"
    texts = ["", " ", "\n", "▁", "  two  spaces ", "<0x41> <s>", *["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(200)]]
    for text in texts:
        for _, ids in segment.nbest(real, text, 4):
            assert segment.decode(real, ids) == text


def test_pieces_are_those_of_the_file(real):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=segment.DEFAULT_MODEL)
    for _, ids in segment.nbest(real, "The quick brown fox jumps over the lazy dog.", 3):
        assert "".join(model.id_to_piece(i) for i in ids) == "▁The▁quick▁brown▁fox▁jumps▁over▁the▁lazy▁dog."
    assert len(real.pieces) > 30_000 and real.chunks.pattern != r"[\s\S]+"


def test_vocabulary_with_pieces_across_words():
    v = segment.vocabulary([("a", 0, -1.0), (" ", 1, -1.0), ("b", 2, -1.0), ("a b", 3, -0.5)], list(range(10, 266)), -5.0)
    assert segment.nbest(v, "a b", 1)[0][1] == [1, 3]


def test_awkward_rows(odd, nothing):
    out = segment.segment(odd, n=3)
    assert set(out.columns) - set(odd.columns) == {"ids", "n_pieces", "nbest_scores", "nbest_digests", "round_trip"}
    real = segment.load()
    for r in out.collect():
        if r["text"] is None:
            assert r["ids"] is None and r["n_pieces"] is None and r["nbest_scores"] is None and r["round_trip"] is None
        else:
            assert r["round_trip"] and segment.decode(real, r["ids"]) == r["text"] and r["n_pieces"] == len(r["ids"])
            assert len(set(r["nbest_digests"])) == len(r["nbest_scores"]) == len(segment.nbest(real, r["text"], 3))
            assert list(r["nbest_scores"]) == sorted(r["nbest_scores"], reverse=True)
    assert segment.segment(nothing).count() == 0


def test_digests_are_of_the_ids(odd):
    import hashlib
    import numpy as np
    real = segment.load()
    rows = segment.segment(odd.filter("doc_id = 1"), n=4).collect()
    want = [hashlib.md5(np.array(ids, np.int32).tobytes()).hexdigest() for _, ids in segment.nbest(real, rows[0]["text"], 4)]
    assert rows[0]["nbest_digests"] == want and not any(itertools.starmap(lambda a, b: a == b, itertools.combinations(want, 2)))


def test_batches_equal_single_texts():
    v = segment.load()
    texts = ["The cat sat on the mat.", "x\na\nb\n\ny", "Straße über 😀 12345", "wort " * 3_000, "a", "", " ", "\n\n", "wort wort Wort"]
    made = segment.encode_batch(v, texts, 4)
    for i, text in enumerate(texts):
        parts, _, ways = segment.encode(v, segment.split(v, [text])[0], 4)
        own = made.ids[made.starts[i]:made.starts[i + 1]].tolist()
        assert own == [k for part in parts for k in part]
        assert made.scores[i] == [score for score, _ in ways]
        for (_, picks), digest in zip(ways, made.digests[i]):
            ids = [k for place, part in enumerate(parts) for k in picks.get(place, part)]
            assert digest == hashlib.md5(np.array(ids, np.int32).tobytes()).hexdigest()
    assert segment.decode_batch(v, made.ids, made.starts) == [t.encode() for t in texts]


def test_a_table_of_ids_is_decoded(odd, spark):
    coded = segment.segment(odd).withColumnRenamed("text", "was")
    for r in segment.unsegment(coded).collect():
        assert r["text"] == r["was"]
    rows = spark.createDataFrame([(1, None), (2, []), (3, [10**8]), (4, [-1])], "a INT, ids ARRAY<INT>")
    assert [r["text"] for r in segment.unsegment(rows).orderBy("a").collect()] == [None, "", None, None]
    assert segment.unsegment(coded.limit(0)).count() == 0


def test_remembered_chunks_take_little_memory():
    v = segment.load()
    texts = [" ".join(f"{i:x}{k}q" for k in range(1_000)) for i in range(30)]
    segment.split(v, texts[:1])
    tracemalloc.start()
    segment.encode_batch(v, texts)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 30_000 * 230


def test_runs_and_forgetting_change_nothing(monkeypatch):
    texts = ["", *[f"wort {i} Straße {i % 7}\n" * (i % 5) for i in range(60)], "", "x" * 500]
    want = segment.encode_batch(segment.load(), texts)
    v = segment.load()
    monkeypatch.setattr(segment, "_CACHED", 20)
    monkeypatch.setattr(segment, "_CACHED_CHARS", 90)
    monkeypatch.setattr(segment.runs, "__defaults__", (50,))
    made, same = segment.encode_checked(v, texts)
    assert made.ids.tolist() == want.ids.tolist() and made.starts.tolist() == want.starts.tolist()
    assert made.scores == want.scores and made.digests == want.digests and all(same) and len(same) == len(texts)
    assert len(v.solved.place) < 20 and segment.encode_checked(v, [])[1] == []
