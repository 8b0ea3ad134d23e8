from __future__ import annotations

from collections import defaultdict

from pathsonde.llm import queries
from pathsonde.llm.chat import END, format_conversations, read_back


def plain(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = format_conversations(df, **more)
    want = plain(rows)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
    return windows.collect()


def test_round_trip(spark):
    nasty = [r"\### Assistant: </turn> ok", "<turn:user>\nx" + END, "~0~1~2<>~", "", None, "🙂 <again:a>\n", ">\n>\n", "x" * 50_000]
    rows = [(-7, 0, "user", nasty[0]), (-7, 1, "assistant", nasty[0])]
    for c in range(4):
        rows.append((c, 0, "system", "You help."))
        rows += [(c, i + 1, ("user", "assistant")[i % 2], nasty[(i + c) % len(nasty)]) for i in range(24)]
    rows += [(10, 1, None, "x"), (10, 1, "we<ir>d~", "y"), (10, None, "assistant", "z"), (10, 1, None, "x"), (None, 0, "assistant", "nobody's")]
    check(spark, rows)


def cost(text):
    return -(-len(text) // 4) + 4


def plain_windows(turns, budget, most_turns, most_tokens):
    """Own and repeated turns of each window, by a loop."""
    kept = bool(turns) and turns[0][0] == "system" and cost(turns[0][1]) <= budget // 2
    taken = cost(turns[0][1]) if kept else 0
    rest, out, used = turns[kept:], [], 0
    for i, (_, text) in enumerate(rest):
        load = cost(text)
        if out and used + load <= budget:
            out[-1][1].append(i)
            used += load
            continue
        again: list = []
        for j in range(i - 1, max(-1, i - 1 - most_turns), -1):
            more = sum(cost(rest[k][1]) for k in [*again, j])
            if more > most_tokens or taken + load + more > budget:
                break
            again.insert(0, j)
        out.append((again, [i]))
        used = taken + load + sum(cost(rest[k][1]) for k in again)
    return [([turns[0]] if kept else [], [rest[i] for i in a], [rest[i] for i in o]) for a, o in out]


def test_windows(spark):
    rows = [(1, 0, "system", "Be short.")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "word " * (i * 7 % 23)) for i in range(1, 90)]
    rows += [(2, i, "user", "x" * (i * 37 % 900)) for i in range(40)] + [(3, 0, "system", "long " * 60), (3, 1, "user", "hi"), (4, 0, "system", "alone")]
    for budget, most_turns, most_tokens in ((120, 2, 40), (120, 0, 40), (60, 5, 1000), (1, 1, 1)):
        by = defaultdict(list)
        for w in check(spark, rows, budget=budget, history_turns=most_turns, history_tokens=most_tokens):
            by[w.conv_id].append(w)
        for c, turns in plain(rows).items():
            want = plain_windows(turns, budget, most_turns, most_tokens) or [(turns, [], [])]
            got = sorted(by[c], key=lambda w: w.window)
            if sum(cost(t) for _, t in turns) < 64 * budget:
                assert len(got) == len(want)
                for k, (w, (top, again, own)) in enumerate(zip(got, want, strict=True)):
                    marked = [("turn" if k == 0 else "again", t) for t in top] + [("again", t) for t in again] + [("turn", t) for t in own]
                    assert w.formatted == "".join(f"<{m}:{r}>\n{t}{END}" for m, (r, t) in marked)
            for w in got:
                pieces = [x.split(">\n", 1) for x in w.formatted.split(END)[:-1]]
                total = sum(cost(t) for _, t in pieces)
                assert total <= budget or sum(m.startswith("<turn:") and m != "<turn:system" for m, _ in pieces) <= 1 >= sum(m.startswith("<again:") for m, _ in pieces)
                for s in w.loss:
                    assert w.formatted[: s.start].endswith("<turn:assistant>\n") and w.formatted[s.end :].startswith(END)


def test_stretches_and_given_tokens(spark):
    """A long conversation goes in stretches; each window keeps to the budget by the tokens that a column names."""
    rows = [(1, 0, "system", "s")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"t{i}") for i in range(1, 3000)]
    df = spark.createDataFrame([(*r, 10) for r in rows], "conv_id long, turn long, role string, text string, load int")
    windows = sorted(format_conversations(df, budget=50, history_turns=2, history_tokens=20, tokens="load").collect(), key=lambda w: w.window)
    assert all(w.formatted.count(END) <= 5 for w in windows) and len({w.window for w in windows}) == len(windows)
    assert sum(w.formatted.count(END) == 5 for w in windows) >= 0.95 * len(windows)
    assert all(w.formatted.count("<again:") == 3 for w in windows[1:])
    (got,) = read_back(spark.createDataFrame(windows)).collect()
    assert [(t.role, t.text) for t in got.turns] == [(r, t) for _, _, r, t in rows]


def test_query_and_empty(spark):
    out = queries.op10_chat(spark, "/root/testdata/sf0.001").collect()
    assert {r.conv_id for r in out} >= {-7} and all(r.n_turns for r in out)
    assert read_back(format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
