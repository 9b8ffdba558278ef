"""Cycle numbers across files and rules from steps, against a loop over rows and steps."""

import json
import random

from pyspark.sql import functions as F
from voltlake.operators import cycle_rules


def counted(files, rules):
    """One row after the other, through all files of a run."""
    cycle, out = 1, []
    for technique, rows in files:
        start, on_loop, moves = rules.get(technique, (0, 0, {}))
        cycle += start
        before = rows[0]
        for sequence, loop in rows:
            if loop != before[1]:
                cycle += on_loop
            elif sequence != before[0]:
                cycle += moves.get((before[0], sequence), 0)
            before = (sequence, loop)
            out.append(cycle)
    return out


def test_across_files(spark, tmp_path):
    r = random.Random(3)
    rules = {t: (r.randrange(3), r.randrange(3), {(a, b): r.randrange(3) for a in range(4) for b in range(4) if r.random() < 0.7}) for t in (1, 2, 5)}
    rows, want = [], {}
    for run in "ab":
        files = []
        for t in (1, 2, 3, 5) if run == "a" else (2, 5):  # the third has no rules
            files.append((t, [(r.randrange(4), r.randrange(2)) for _ in range(r.randrange(1, 40))]))
        want[run] = counted(files, rules)
        rows += [(run, t, i, s, loop) for t, f in files for i, (s, loop) in enumerate(f)]
    r.shuffle(rows)
    for t, (start, on_loop, moves) in rules.items():
        text = {"tech_num": t, "tech_does_loop": True, "adv_cycle_on_start": start, "adv_cycle_on_tech_loop": on_loop, "debug_adv_cycle_on_step_transitions": []}
        text["adv_cycle_seq_transitions"] = [{"source": a, "target": b, "adv_cycle_count": n} for (a, b), n in moves.items()]
        (tmp_path / f"technique_{t}.json").write_text(json.dumps(text, indent=2))
    known = cycle_rules.read_rules(spark, str(tmp_path))
    df = spark.createDataFrame(rows, "run_id string, technique int, data_point int, sequence int, loop int")
    got = cycle_rules.cycles_across_files(df, known).orderBy("run_id", "technique", "data_point").collect()
    assert all([x.cycle_index for x in got if x.run_id == run] == want[run] for run in "ab")
    # Rules by run, equal transitions: the last counts.
    own = spark.createDataFrame([("a", 1, 4, 0, [(0, 1, 9), (0, 1, 2)])], "run_id string, technique int, on_start int, on_loop int, transitions array<struct<source: int, target: int, advance: int>>")
    two = spark.createDataFrame([("a", 1, 0, 0, 7), ("a", 1, 1, 1, 7), ("z", 1, 0, 0, 7), ("z", 1, 1, 1, 7)], df.schema)
    assert sorted((x.run_id, x.cycle_index) for x in cycle_rules.cycles_across_files(two, own).collect()) == [("a", 5), ("a", 7), ("z", 1), ("z", 1)]
    assert cycle_rules.cycles_across_files(two.limit(0), own).count() == 0


def played(kinds, loops):
    """The measured steps that a technique goes through, with the advances before each, its loop done once more."""
    order, i, back = [], 0, loops
    opened = None
    while i < len(kinds):
        if kinds[i] == "loop_open":
            opened = i
        order.append(i)
        if kinds[i] == "loop_close" and opened is not None and back:
            back, i = back - 1, opened
        i += 1
    out, n = [], 0
    for i in order:
        if kinds[i] == "advance":
            n += 1
        elif kinds[i] == "measured":
            out.append((i + 1, n))
            n = 0
    return out, n


def test_rules_from_steps(spark):
    """Cycle numbers by the rules are those of the technique played step by step."""
    r = random.Random(4)
    tables = {}
    for p in range(40):
        body = lambda n: [r.choice(("measured", "measured", "advance")) for _ in range(n)]
        tables[p] = [body(r.randrange(4)) + ["loop_open"] + body(r.randrange(1, 5)) + ["loop_close"] + body(r.randrange(4)) for _ in range(2)]
    rows = [(p, t, i + 1, k) for p, ts in tables.items() for t, kinds in enumerate(ts) for i, k in enumerate(kinds)]
    rules, problems = cycle_rules.rules_from_steps(spark.createDataFrame(rows, "protocol int, technique int, step int, kind string"))
    found = {(x.protocol, x.technique): (x.on_start, x.on_loop, {(m.source, m.target): m.advance for m in x.transitions}) for x in rules.collect()}
    told = {(x.protocol, x.technique) for x in problems.collect()}
    checked = 0
    for p, ts in tables.items():
        left = 0
        for t, kinds in enumerate(ts):
            on_start, on_loop, moves = found[p, t]
            walk, rest = played(kinds, 1)
            first = played(kinds, 0)[0]
            assert on_start == left + (first[0][1] if first else 0)
            left = on_loop
            if not first:
                continue
            if (p, t) in told:
                continue
            # Where one transition is straight and back at once, no rule can tell them apart.
            pairs = {}
            clash = False
            for (a, _), (b, n) in zip(walk, walk[1:]):
                clash |= pairs.setdefault((a, b), n) != n
            if not clash:
                checked += 1
                assert all(moves.get(ab, 0) == n for ab, n in pairs.items() if ab[0] != ab[1]) and rest == on_loop
    assert checked > 30


def test_problems_and_sequences(spark):
    kinds = {1: ["loop_open", "measured", "advance", "loop_close"], 2: ["loop_open", "advance", "loop_close"], 3: ["loop_close", "measured"], 4: ["loop_open", "loop_open", "measured", "loop_close"], 5: ["measured", "advance", "measured"]}
    rows = [(p, 0, i + 1, k, 10 * i, 10 * i + 3) for p, ks in kinds.items() for i, k in enumerate(ks)]
    rules, problems = cycle_rules.rules_from_steps(spark.createDataFrame(rows, "protocol int, technique int, step int, kind string, first_sequence int, last_sequence int"))
    got = {x.protocol: (x.step, x.problem) for x in problems.collect()}
    assert got == {1: (4, "the loop advances, but has one measured step"), 2: (3, "the loop advances, but has no measured step"), 3: (1, "the loop was not opened"), 4: (2, "the loop before was not closed")}
    moves = {x.protocol: [tuple(m) for m in x.transitions] for x in rules.where(F.size("transitions") > 0).collect()}
    assert moves == {5: [(3, 20, 1)]}
