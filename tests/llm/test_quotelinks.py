import random
from collections import defaultdict

from claimloom.llm import quotelinks as Q

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


def quote(text, level=1):
    return "\n".join("> " * level + line for line in text.split("\n"))


def test_parse():
    own, runs = Q.parse_quotes("Ann wrote:\n> a\n> > b\n>> c\n> d\n\nI agree.")
    assert own == "I agree." and runs == [(1, ["a"]), (2, ["b", "c"]), (1, ["d"])]
    assert Q.parse_quotes("a > b\nc") == ("a > b\nc", [])
    assert set(Q.units(["Hello,  World"])) == set(Q.units(["hello world!"]))


def brute(rows):
    """Links by looking at every earlier message of the conversation, then everywhere."""
    own = {(c, t): Q.units(Q.parse_quotes(x or "")[0].split("\n")) for c, t, _, x in rows}
    out = {}
    for c, t, _, x in rows:
        votes = defaultdict(int)
        for level, lines in {(lv, tuple(ls)) for lv, ls in Q.parse_quotes(x or "")[1]}:
            for h, w in Q.units(list(lines)).items():
                here = [u for (d, u), hs in own.items() if d == c and h in hs]
                every = sorted((d, u) for (d, u), hs in own.items() if h in hs)
                if here and min(here) < t:
                    votes[True, -level, (c, min(here)), h] = w
                elif every and every[0][0] != c:
                    votes[False, -level, every[0], h] = w
        total = defaultdict(int)
        for (inside, level, origin, _), w in votes.items():
            total[inside, level, origin] += w
        best = max(((i, lv, w, o[1], o) for (i, lv, o), w in total.items()), default=None)
        out[c, t] = (best[4][1] if best and best[0] else None, best[4] if best else (None, None))
    return out


def thread(rng, c, n):
    rows, bodies = [], []
    for t in range(n):
        body = "\n".join(" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=rng.randint(3, 8))) + f" c{c} t{t}" for _ in range(rng.randint(1, 3)))
        text = body
        if t and rng.random() < 0.7:
            source = rng.randrange(t)
            text = f"They wrote:\n{quote(bodies[source].upper() if rng.random() < 0.3 else bodies[source])}\n\n{body}"
            if source and rng.random() < 0.5:
                text = quote(bodies[source - 1], 2) + "\n" + text
        rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
        bodies.append(body)
    return rows, bodies


def test_links_and_order_against_brute_force(spark):
    rng = random.Random(4)
    rows, first = [], []
    for c in range(12):
        more, bodies = thread(rng, c, rng.randint(1, 9))
        rows += more
        first.append(bodies[0])
    rows.append((50, 0, "user", quote(first[3]) + "\nfrom elsewhere"))
    rows.append((51, 0, "user", "> nobody said this\nhm"))
    want = brute(rows)
    got = {(r.conv, r.turn): r for r in Q.link_quotes(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for key, (reply, origin) in want.items():
        assert got[key].reply_turn == reply and (got[key].origin_conv, got[key].origin_turn) == origin, key
        assert ">" not in got[key].clean and "wrote:" not in got[key].clean
    paths = {}
    for c, t, _, _ in rows:
        path, at = [t], want[c, t][0]
        while at is not None:
            path.insert(0, at)
            at = want[c, at][0]
        paths[c, t] = path
    for c in {c for c, *_ in rows}:
        order = sorted((k for k in paths if k[0] == c), key=lambda k: paths[k])
        assert [got[k].position for k in order] == list(range(len(order)))
        assert all(got[k].depth == len(paths[k]) - 1 and got[k].thread_turn == paths[k][0] for k in order)
    assert got[50, 0].origin_conv == 3 and got[50, 0].clean == "from elsewhere"


def test_long_chain(spark):
    rows = [(1, 0, "user", "start 0")] + [(1, t, "user", quote(f"start {t - 1}") + f"\nstart {t}") for t in range(1, 40)]
    got = {r.turn: r for r in Q.link_quotes(table(spark, rows)).collect()}
    assert [got[t].depth for t in range(40)] == list(range(40))


def test_odd_rows(spark):
    rows = [(None, 1, None, None), (None, 2, "user", ""), (7, None, "user", "> hm"), (7, 0, "user", "hm"), (7, 0, "user", "hm"), (7, 1, None, ">>>> \n>")]
    got = Q.link_quotes(table(spark, rows)).collect()
    assert len(got) == 6
    assert sorted(r.position for r in got if r.conv == 7) == [0, 1, 2, 3]
    assert sorted(r.position for r in got if r.conv is None) == [0, 1]
    assert Q.link_quotes(table(spark, rows).where("turn > 9")).collect() == []


def test_original_elsewhere_when_the_asker_repeats_the_quote(spark):
    line = "the kettle was never plugged in at all"
    rows = [(1, 0, "user", f"> {line}\n{line}"), (2, 0, "user", line), (3, 0, "user", line), (4, 0, "user", f"> {line}")]
    out = Q.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv: (r.origin_conv, r.origin_turn, r.n_linked > 0) for r in out.collect()}
    assert got == {1: (2, 0, True), 2: (None, None, False), 3: (None, None, False), 4: (1, 0, True)}
