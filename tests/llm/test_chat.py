import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.llm import chat as C

texts = st.text(alphabet="<|\\>im_endstar \n/aé😀", max_size=30)
roles = st.text(alphabet="user\\\n<|", max_size=6)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), roles), texts), max_size=14))
def test_any_turns_are_read_back_and_spans_hold_exactly_the_texts(turns):
    text, spans, rewrote = C.locate(turns, window=2)
    assert text == C.ChatML.render(turns) and C.ChatML.parse(text) == turns and rewrote == []
    at = 0
    for (_, words), (start, end, a, b) in zip(turns, spans, strict=True):
        assert start == at and start <= a <= b <= end and C.unescape(text[a:b]) == words
        at = end
    assert at == len(text)


def test_windows_give_what_whole_prefixes_give():
    first = C.Template(lambda t: "".join(f"[{'BOS ' if k == 0 else ''}{r}:{x}]" for k, (r, x) in enumerate(t)))
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k} mnm pqp") for k in range(60)]
    for template in (C.ChatML, first):
        assert C.locate(turns, template, 3) == C.locate(turns, template, 100) == (template.render(turns), *C._by_whole_prefixes(turns, template, template.render(turns)))


def test_a_long_reach_is_caught_by_the_whole_rendering():
    counted = C.Template(lambda t: f"{len(t) > 20}" + "".join(f"({x})" for _, x in t))
    turns = [("user", f"t{k}") for k in range(30)]
    text, spans, rewrote = C.locate(turns, counted, 3)
    assert rewrote == [20] and text == counted.render(turns)
    assert [text[a:b] for *_, a, b in spans] == [x for _, x in turns]
    assert spans[5][0] is None and spans[25][0] is not None  # turns before the change are found by their text alone


def test_history_that_is_rewritten():
    turns = [("user", "q"), ("assistant", "<think>hm</think> a"), ("user", "r"), ("assistant", "<think>so</think> b")]
    text, spans, rewrote = C.locate(turns, C.ChatMLLastReasoning)
    assert rewrote == [2] and "hm" not in text and "so" in text
    assert spans[1][2] is None  # its whole text is not there
    assert [text[a:b] for _, _, a, b in (spans[0], spans[2], spans[3])] == ["q", "r", "<think>so</think> b"]
    suffix = C.Template(lambda t: "".join(f"{x};" for _, x in t) + "END")
    assert C.locate(turns, suffix)[2] == [0, 1, 2, 3]


def test_texts_that_a_template_trims_have_no_span():
    trims = C.Template(lambda t: "".join(f"<{x.strip()}>" for _, x in t))
    text, spans, _ = C.locate([("user", "a"), ("assistant", " b ")], trims)
    assert text == "<a><b>" and spans == [(0, 3, 1, 2), (3, 6, None, None)]


def want(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), sha(said), len(learned), sha(learned), len(C.ChatML.render(turns)))
    return out


def read(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_digest_equals_the_turns(spark):
    rows = [(k % 7, k, ("system", "user", "assistant", None)[k % 4], None if k % 11 == 0 else f"t{k} <|im_end|>" + "x" * k) for k in range(80)]
    rows += [(9, 1, "user", "same"), (9, 1, "user", "same"), (9, None, "assistant", "")]  # repeated rows, ties, null turn
    rows += [(None, 0, "assistant", "nobody's"), (None, 1, "user", "é")]
    rows += [(10, k, "user" if k % 2 == 0 else "assistant", f"<\\|{k}|") for k in range(300)]  # a long conversation
    rows += [(11, 0, "assistant", "y" * 5_000_000)]
    schema = "conv_id long, turn long, role string, text string"
    chats = spark.createDataFrame([(*r, "x", 1) for r in rows], schema + ", formatted string, spans int").repartition(5)
    planted = [(-1, k, r, C.PLANTED) for k, r in enumerate(("user", "assistant"))]
    assert read(C.digest(C.format_chats(C.with_planted(chats)))) == want(rows + planted)
    assert C.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_a_refusing_template_is_reported(spark):
    def fussy(turns):
        if any(role not in ("user", "assistant") for role, _ in turns):
            raise ValueError("unknown role")
        return C.ChatML.render(turns)

    chats = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "tool", "b")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.format_chats(chats, C.Template(fussy, C.unescape)).collect()}
    assert got[1]["error"] is None and got[1]["formatted"] and got[2]["formatted"] is None and "unknown role" in got[2]["error"]


def test_long_texts_in_common():
    for a, b, n, m in (("abc", "abd", 2, 0), ("", "a", 0, 0), ("xab", "yab", 0, 2), ("same", "same", 4, 4)):
        assert (C.common(a, b), C.common_end(a, b)) == (n, m)


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|im_start|>", "<<|", "|", "\\<|\\|"])
def test_escapes_are_reversible(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
