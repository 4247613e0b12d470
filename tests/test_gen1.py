"""Scores of the first generation against a plain loop over planted answers and judges."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

UNITS = [f"U{i}" for i in range(1, 7)]


def test_answers_and_diagnoses_are_strict():
    from weftline.functions.parsing import parse_diagnosis, parse_graph

    edge = {"source": "U2", "target": "U1", "type": "responds_to"}
    good = json.dumps({"relations": [edge]})
    assert parse_graph(good) == (True, [{"source": "U2", "target": "U1"}]) and parse_graph('{"relations": []}') == (True, [])
    for bad in (None, "", "[]", json.dumps({"relations": [edge, edge]}), json.dumps({"relations": [edge | {"type": "attacks"}]}), json.dumps({"relations": [edge | {"source": "U0"}]}), json.dumps({"relations": [edge | {"x": 1}]}), json.dumps({"relations": [edge], "y": 1}), f"```\n{good}\n```"):
        assert parse_graph(bad) == (False, []), bad
    told = {"assessment": "correct", "missed_edges": [], "spurious_edges": [], "brief_reason": "r"}
    assert parse_diagnosis(json.dumps(told)) == (True, None, None, [], [])
    assert parse_diagnosis(json.dumps(told | {"spec_adherence": 4, "robustness": 0}))[1:3] == (4, 0)
    for bad in (told | {"spec_adherence": 4}, told | {"spec_adherence": 5, "robustness": 1}, told | {"assessment": "fine"}, told | {"brief_reason": ""}, told | {"missed_edges": [{"source": "U1"}]}, told | {"z": 1}):
        assert parse_diagnosis(json.dumps(bad)) is None, bad


def planted():
    rng = random.Random(6)
    cases, records = {}, []
    kinds = ("topical_nonresponse", "same_side_extension")
    for i in range(12):
        pairs = [(a, b) for a in UNITS for b in UNITS if int(a[1:]) > int(b[1:])]
        gold = set(rng.sample(pairs, rng.randrange(0, 4)))
        hard = [(rng.choice(kinds), *p) for p in pairs if p not in gold and rng.random() < 0.3]
        cases[f"s{i}"] = (rng.choice("xy"), rng.choice("de"), rng.sample(("p1", "p2", "p3"), rng.randrange(0, 4)), gold, hard)
    for i in range(150):
        scenario = f"s{rng.randrange(12)}"
        gold, hard = cases[scenario][3:]
        told = {e for e in gold if rng.random() < 0.8} | {h[1:] for h in hard if rng.random() < 0.15} | ({("U6", "U6")} if rng.random() < 0.05 else set())
        body = json.dumps({"relations": [{"source": a, "target": b, "type": "responds_to"} for a, b in sorted(told)]})
        form = rng.random()
        raw = body if form < 0.6 else f"```json\n{body}\n```" if form < 0.8 else body[:-1] if form < 0.9 else None
        parts = lambda es: [{"source": a, "target": b} for a, b in es]
        judge = {"assessment": rng.choice(("correct", "incorrect")), "missed_edges": parts(gold - told if rng.random() < 0.7 else []), "spurious_edges": parts(told - gold), "brief_reason": "r"}
        if rng.random() < 0.6:
            judge |= {"spec_adherence": rng.randrange(5), "robustness": rng.randrange(5)}
        asked = rng.random()
        records.append((rng.choice("ab"), "q", scenario, raw, None if asked < 0.1 else "no judge" if asked < 0.2 else json.dumps(judge)))
    return cases, records


def replay(cases, records):
    from weftline.functions.parsing import parse_diagnosis, parse_graph

    sums, hits = defaultdict(Counter), defaultdict(Counter)
    for provider, prompt, scenario, raw, judged in records:
        category, split, phenomena, gold, hard = cases[scenario]
        scopes = [("overall", "all"), ("category", category), ("split", split), ("model_prompt", f"{provider}:{prompt}"), *(("phenomenon", p) for p in phenomena)]
        c = Counter(assignments=1, judge_assignments=judged is not None)
        judge = parse_diagnosis(judged)
        valid, edges = parse_graph(raw)
        loose = (valid, edges) if valid or raw is None else parse_graph(raw.removeprefix("```json\n").removesuffix("\n```"))
        marks = Counter()
        for p, (ok, told) in (("", (valid, edges)), ("normalized_", loose)):
            told = {(e["source"], e["target"]) for e in told}
            exact = ok and told == gold
            c.update({f"{p}valid": ok, f"{p}exact": exact, f"{p}tp": len(told & gold), f"{p}fp": len(told - gold), f"{p}fn": len(gold - told)})
            for kind, a, b in hard:
                marks[kind, f"{p}hits"] += (a, b) in told
            if judge is not None:
                of = lambda es: {(e["source"], e["target"]) for e in es}
                c.update({f"{p}agreement": judge[0] == exact, f"{p}diagnosis": of(judge[3]) == gold - told and of(judge[4]) == told - gold})
        if judge is not None:
            c.update(judge_valid=1, judge_says_correct=judge[0])
            if judge[1] is not None:
                c.update(rubric_scored=1, spec_total=judge[1], robustness_total=judge[2])
        for s in scopes:
            sums[s].update(c)
            for kind, *_ in hard:
                hits[*s, kind]["pairs"] += 1
            for (kind, name), n in marks.items():
                hits[*s, kind][name] += n
    return sums, hits


def test_scores_of_planted_answers(spark):
    from weftline.operators.gen1 import graph_scores, hard_negative_rates, record_facts

    cases, records = planted()
    e = spark.createDataFrame([(k, c, s, p, sorted(g), h) for k, (c, s, p, g, h) in cases.items()], "scenario_id string, category string, split string, phenomena array<string>, gold array<struct<source string, target string>>, hard array<struct<phenomenon string, source string, target string>>")
    r = spark.createDataFrame(records, "provider string, prompt string, scenario_id string, raw_response string, raw_judge string")
    facts = record_facts(r, e).cache()
    sums, hits = replay(cases, records)
    got = {(x["scope"], x["value"]): x for x in graph_scores(facts).collect()}
    assert set(got) == set(sums)
    over = lambda a, b: a / b if b else None
    for scope, c in sums.items():
        x = got[scope].asDict()
        counts = {k: x[k] for k, t in facts.dtypes if t == "bigint"}
        assert counts == {k: int(c[k]) for k in counts}, scope
        assert x["agreement_rate"] == over(c["agreement"], c["judge_assignments"]) and x["normalized_diagnosis_rate"] == over(c["normalized_diagnosis"], c["judge_assignments"])
        assert x["precision"] == over(c["tp"], c["tp"] + c["fp"]) and x["mean_spec"] == over(c["spec_total"], c["rubric_scored"])
    assert got["overall", "all"].assignments == len(records)
    found = {(x["scope"], x["value"], x.kind): (x.pairs, x.hits, x.normalized_hits) for x in hard_negative_rates(facts).collect()}
    assert found == {k: (c["pairs"], c["hits"], c["normalized_hits"]) for k, c in hits.items()}
    facts.unpersist()
