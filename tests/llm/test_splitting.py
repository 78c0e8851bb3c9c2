import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import splitting as sp


def u16(s):
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab \n.!。\t😀x", max_size=140), st.integers(24, 60), st.integers(0, 10))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    parts = sp.pieces(text, limit, overlap)
    assert "".join(text[o:e] for _, o, e in parts) == text
    for i, (start, own, end) in enumerate(parts):
        assert u16(text[start:end]) <= limit and (end > own or not text)
        if i:
            assert u16(text[start:own]) in (overlap, overlap + 1) or start == 0
    assert sp.units(text) == u16(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word ", "more words. ", "line\n", "para\n\n", "x" * 30 + " "]), min_size=20, max_size=60))
def test_cuts_follow_boundaries_and_none_can_be_merged(parts):
    text = "".join(parts)
    at = sp.cuts(text, 60, 8)[0]
    ends = {e for _, e, _ in sp.atoms(text)}
    assert all(c in ends for c in at[1:])
    assert all(c - a > 60 - 8 - 1 for a, c in zip(at, at[2:]))


def test_paragraphs_are_kept_over_blanks():
    text = "aa bb cc dd\n\n" * 8
    assert all(c % 13 == 0 for c in sp.cuts(text, 64, 8)[0])


def one_heap(text, room):
    """All atoms in one heap."""
    segments, at = [], 0
    for _, end, s in sp.atoms(text):
        while sp.units(text[at:end]) > room:
            stop = at
            while sp.units(text[at : stop + 1]) <= room:
                stop += 1
            segments.append((stop, sp.units(text[at:stop]), sp.NONE))
            at = stop
        segments.append((end, sp.units(text[at:end]), s))
        at = end
    return [0] + [e for e, _, _ in sp._merge(segments, room)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["w ", "wo ", "end. ", "so! ", "line\n", "para\n\n", "cr\r\n\r\n", "x" * 50, "😀", "。"]), max_size=80))
def test_parts_merged_as_read_equal_one_heap(parts):
    text = "".join(parts)
    at, longest = sp.cuts(text, 40, 6)
    assert at == one_heap(text, 40 - 6 - 1)
    assert longest == max(map(sp.units, re.split(r"[ \t\n.!?;。！？；]", text)))


def test_table_with_dirty_rows(spark):
    rows = [(1, "short"), (2, ""), (3, None), (None, "x" * 9000), (4, "w " * 3000), (4, "w " * 3000), (5, "😀" * 2048), (6, "😀" * 2049), (7, "é" * 4096), (8, "a" * 4097 + " b"), (9, "y " * 400_000)]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "id bigint, text string, piece int, hard string")
    out = sp.split_oversized(df).collect()
    own = {}
    for r in out:
        assert u16(r.text) <= 4096
        own.setdefault(r.id, []).append((r.piece, r.text[r.own_start - r.start :]))
    assert {k: len(v) for k, v in own.items() if k in (1, 2, 3, 5, 7)} == {1: 1, 5: 1, 7: 1}
    assert "".join(t for _, t in sorted(own[9])) == "y " * 400_000
    assert sorted((r.id or 0, r.hard) for r in sp.oversized(df).collect()) == [(0, 1), (4, 0), (4, 0), (6, 1), (8, 1), (9, 0)]
    assert sp.split_oversized(df.limit(0)).count() == 0
