"""Chat formatting: black-box spans for templates of several kinds, reversible marks, and the odd inputs."""

import hashlib
import itertools
import random

import pytest

from fleetlens.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n_turns string"


def system_inside(turns):
    """A system text is printed inside the first user turn, so it moves when that turn comes."""
    out, system = [], ""
    for role, text in turns:
        if role == "system":
            system = f"<<SYS>>{text}<</SYS>>"
        elif role == "user":
            out.append(f"[INST]{system}{text}[/INST]")
            system = ""
        else:
            out.append(f"{text}</s>")
    return "".join(out) + (f"[INST]{system}[/INST]" if system else "")


def forgets_thoughts(turns):
    """Only the last answer keeps what stands before the bar."""
    last = max((k for k, t in enumerate(turns) if t[0] == "assistant"), default=-1)
    return "".join(f"{r}:{t if k == last or r != 'assistant' else t.split('|')[-1]}\n" for k, (r, t) in enumerate(turns))


def trims(turns):
    return "".join(f"<{r}>{t.strip()}</{r}>" for r, t in turns)


def ends_with_prompt(turns):
    return "".join(f"{r}: {t};" for r, t in turns) + "next:"


def test_spans_of_a_template_that_goes_on():
    turns = [("system", "s"), ("user", " a "), ("assistant", "</s>"), ("user", ""), ("assistant", " b\n")]
    got = chat.rendered(turns, chat.marked_turns)
    assert got.rewrites == [] and "".join(got.formatted[b:e] for b, e in got.turns) == got.formatted
    assert [chat.unescaped(got.formatted[b:e]) for b, e in got.loss] == ["</s>", " b\n"]
    assert [chat.read_back(got.formatted[b:e]) for b, e in got.turns] == [[t] for t in turns]


def test_rewritten_history_is_found():
    got = chat.rendered([("system", "be"), ("user", "q"), ("assistant", "a")], system_inside)
    assert got.formatted == "[INST]<<SYS>>be<</SYS>>q[/INST]a</s>" and got.rewrites == [(1, 23)]
    assert [got.formatted[b:e] for b, e in got.turns] == ["be", "q", "a"] and [got.formatted[b:e] for b, e in got.loss] == ["a"]
    turns = [("user", "q"), ("assistant", "why|x"), ("user", "r"), ("assistant", "how|y")]
    got = chat.rendered(turns, forgets_thoughts)
    assert [k for k, _ in got.rewrites] == [3] and got.formatted == "user:q\nassistant:x\nuser:r\nassistant:how|y\n"
    assert [got.formatted[b:e] for b, e in got.loss] == ["x", "how|y"]
    got = chat.rendered([("user", "q"), ("assistant", "a")], ends_with_prompt)
    assert [k for k, _ in got.rewrites] == [0, 1] and [got.formatted[b:e] for b, e in got.turns] == ["q", "a"]


def test_a_trimming_template_masks_what_it_prints_and_a_silent_one_nothing():
    got = chat.rendered([("user", " q "), ("assistant", "  a b\n")], trims)
    assert not got.rewrites and [got.formatted[b:e] for b, e in got.loss] == ["a b"]
    got = chat.rendered([("user", "q"), ("assistant", "a")], lambda turns: "".join(t for r, t in turns if r == "user"))
    assert got.loss == [] and got.turns == [(0, 1), (-1, -1)] and chat.rendered([], trims).formatted == ""


def test_a_text_with_the_probe_itself():
    turns = [("user", "\U0010fffd"), ("assistant", "\U0010fffd\U0010fffc"), ("assistant", "x")]
    got = chat.rendered(turns, chat.marked_turns)
    assert [got.formatted[b:e] for b, e in got.loss] == ["\U0010fffd\U0010fffc", "x"]


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(5)
    bits = [*chat.CONTROL, "\\", "<", ">", "[", "]", "/", "s", " ", "INST", "a", "<\\s>", "[\\\\/INST]"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += [x[:1] + "\\" * n + x[1:] for x, n in itertools.product(chat.CONTROL, range(4))]
    for t in texts:
        assert chat.unescaped(chat.escaped(t)) == t and not any(c in chat.escaped(t) for c in chat.CONTROL)
    assert len({chat.escaped(t) for t in texts}) == len(set(texts))
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[ROLE]", "</s>"]), rng.choice(texts)) for _ in range(rng.randrange(6))]
        got = chat.rendered(turns, chat.marked_turns)
        assert chat.read_back(got.formatted) == turns
        assert [chat.unescaped(got.formatted[b:e]) for b, e in got.loss] == [t for r, t in turns if r == "assistant"]


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.marked_turns(turns)))
    return out


def test_odd_rows(spark):
    rows = [(1, 2, "user", "late"), (1, 0, "system", None), (1, 1, None, "no role"), (2, None, "user", "no turn"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, 0, "assistant", "w")]
    rows += [(None, 0, "user", "nobody's"), (3, 0, "assistant", "漢🙂" * 50_000), *chat.HOSTILE, *((4, k, ("user", "assistant")[k % 2], f"turn {k} " * 20) for k in range(300))]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    chats = chat.formatted_chats(df)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chats).collect()}
    assert got == brute(rows)
    assert all(r.rewrites == [] and len(r.turn_spans) == r.n_turns for r in chats.collect())
    assert chat.formatted_chats(df.filter("false")).count() == 0
    some = df.filter("conv_id = 1").withColumn("turn", df.turn)
    (told,) = chat.formatted_chats(some, lambda turns: "".join(f"{r}|{t}" for r, t in reversed(turns))).collect()
    assert [r.turn for r in told.rewrites] == [1, 2]


@pytest.mark.parametrize("roles", [("user",), ("user", "assistant"), ()])
def test_loss_roles(spark, roles):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    (r,) = chat.formatted_chats(df, loss_roles=roles).collect()
    assert [r.formatted[s.begin : s.end] for s in r.loss_spans] == [t for role, t in (("user", "a"), ("assistant", "b")) if role in roles]
