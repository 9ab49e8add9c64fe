"""Preference formatting against a plain loop; masks cut out exactly the assistant texts."""

from rankweave.llm import chat


def rendered(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return n, rendered(chosen[:n]), rendered(chosen[n:]), rendered(rejected[n:])


def check(rows, sides):
    for r in rows:
        chosen, rejected = sides[r["pair_id"]]
        assert (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) == brute(chosen, rejected)
        for side, turns in (("chosen", chosen), ("rejected", rejected)):
            whole = r["prompt"] + r[side]
            assert [whole[s["start"]:s["end"]] for s in r[f"{side}_mask"]] == [t for role, t in turns[r["n_common"]:] if role == "assistant"]
        assert r["usable"] == (r["chosen"] != r["rejected"] and bool(r["chosen_mask"]) and bool(r["rejected_mask"]))


def test_pairs(spark):
    a, u, s = "assistant", "user", "system"
    sides = {
        1: ([(u, "q"), (a, "yes")], [(u, "q"), (a, "no")]),
        2: ([(u, "q"), (a, "😀 é"), (u, "more"), (a, "end")], [(u, "q"), (a, "😀 é"), (u, "less"), (a, "fin"), (a, "")]),
        3: ([(u, "q")], [(u, "q")]),
        4: ([(s, "x"), (u, "q")], [(u, "q"), (a, "z")]),
        5: ([(u, "q"), (a, "r")], [(u, "q")]),
        6: ([(u, "q")], []),
        None: ([(a, "r")], [(a, "t")]),
    }
    make = lambda k: spark.createDataFrame([(p, v[k]) for p, v in sides.items() if v[k]], "pair long, turns array<struct<role:string,text:string>>")
    rows = chat.preference(make(0), make(1)).collect()
    assert len(rows) == len(sides)
    check(rows, sides)


def test_swapped_replies_on_awkward_rows(spark):
    rows = [(0, 1, "assistant", "A0"), (0, 0, "user", "q0"), (1, 0, "user", "q1"), (1, 1, "assistant", "A1"), (1, 2, "user", "bye"),
            (2, 0, "user", None), (3, 0, None, "x"), (3, 1, "assistant", "A3"), (4, 0, "user", "alone"), (4, 1, "assistant", "A4"),
            (6, 0, "assistant", "same"), (7, 0, "assistant", "same"), (8, 1, "user", "tie"), (8, 1, "assistant", "tie"), (None, 0, "user", "n")]
    table = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, pair int")
    chosen, rejected = chat.swapped_replies(table)
    got = {r["pair"]: [tuple(x) for x in r["turns"]] for r in rejected.collect()}
    assert got[0] == [("user", "q0"), ("assistant", "A1")]
    assert got[1] == [("user", "q1"), ("assistant", "A0"), ("user", "bye")]
    assert got[2] == [("user", "")] and got[3] == [("unknown", "x"), ("assistant", "A3")]
    assert got[4] == [("user", "alone"), ("assistant", "A4")] and got[8] == [("assistant", "tie"), ("user", "tie")]
    own = {r["pair"]: [tuple(x) for x in r["turns"]] for r in chosen.collect()}
    out = chat.preference(chosen, rejected).collect()
    check(out, {p: (own[p], got[p]) for p in own})
    assert {r["pair_id"] for r in out if r["usable"]} == {0, 1}
    empty = table.limit(0)
    assert chat.preference(*chat.swapped_replies(empty)).count() == 0
