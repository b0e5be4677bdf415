"""Verification in stages against a plain simulation, tolerant verdicts, targeted retrieval against a plain loop."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lucerna.functions import numbers as n
from lucerna.operators import evidence as e
from lucerna.operators import verify as v

PAYLOADS = {
    '{"verdicts": [1, {"claim_id": 2, "verdict": "SUPPORTED", "supporting_segments": [1], "explanation": "Ok"}]}': [(2, "SUPPORTED", [1], "Ok")],
    '{"verdicts": [1]}': [],
    '{"verdicts": []}': [],
    'text {"verdicts": ["{\\"claim_id\\": \\"claim 7\\", \\"verdict\\": \\"refuted\\", \\"supporting_segments\\": \\"segments 2 and 3\\"}", "no", null]}': [(7, "CONTRADICTED", [2, 3], "")],
    '{"properties": {"verdicts": [{"claim_id": 1.0, "verdict": "odd", "supporting_segments": 4}]}}': [(1, "NEUTRAL", [4], "")],
    '{"verdicts": [{"claim_id": 1}]}': None,
    '{"verdicts": [{"claim_id"': None,
    '{"verdicts": 5}': None,
    "": None,
    "none": None,
}


def test_batch_verdicts(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*PAYLOADS, None])], "id long, payload string").select("id", v.batch_verdicts(F.col("payload")).alias("x")).collect()
    got = {r.id: None if r.x is None else [(x.claim_id, x.verdict, x.segments, x.explanation) for x in r.x] for r in rows}
    assert got == dict(enumerate([*PAYLOADS.values(), None]))


CLAIM = "The {} clause number {} covers all damage to the house and garden."
REFUSAL = "I cannot verify this from the context."


class Told:
    """A judge that says what a table says; what the table doesn't have is a failed call."""

    def __init__(self, spark, said):
        self.table = spark.createDataFrame([(s, q, c, p) for (s, q, c), p in said.items()], "stage string, q string, c int, payload string")

    def _of(self, stage):
        return self.table.where(F.col("stage") == stage).drop("stage")

    def fused(self, answers, served):
        return answers.join(self._of("fused"), answers["query_id"] == F.col("q"), "left").select("query_id", "payload")

    def batch(self, claims, served, attempt):
        asked = claims.select("query_id").distinct()
        return asked.join(self._of(f"batch{attempt}"), asked["query_id"] == F.col("q"), "left").select("query_id", "payload")

    def alone(self, claims, served):
        own = self._of("alone")
        return claims.join(own, (claims["query_id"] == own["q"]) & (claims["claim_no"] == own["c"]), "left").select("query_id", "claim_no", "payload")


def case(seed, n_answers=24):
    """Answers, served answers, and what the judge says in each stage."""
    rng, answers, said = random.Random(seed), {}, {}
    verdict = lambda: rng.choice(["SUPPORTED", "CONTRADICTED", "NEUTRAL"])
    for i in range(n_answers):
        q = f"q{i}"
        answers[q] = rng.choice([None, "", REFUSAL]) if i % 8 == 0 else " ".join(CLAIM.format(q, k) for k in range(rng.randint(1, 7)))
        count = len((answers[q] or "").split(". "))
        if rng.random() < 0.3:
            items = [{"claim": CLAIM.format(q, k), "verdict": verdict(), "supporting_segments": [1]} for k in range(rng.randint(0, 6))]
            said["fused", q, 0] = json.dumps({"items": items + [{"claim": "The user asks for a clause.", "verdict": "SUPPORTED"}]})
        for attempt in (0, 1):
            if rng.random() < 0.5:
                some = [k for k in range(1, count + 1) if rng.random() < 0.6]
                said[f"batch{attempt}", q, 0] = json.dumps({"verdicts": [3, *({"claim_id": k, "verdict": verdict()} for k in some), *({"claim_id": k, "verdict": "NEUTRAL"} for k in some[:1])]})
        for k in range(1, 9):
            if rng.random() < 0.7:
                said["alone", q, k] = json.dumps({"verdicts": [{"claim_id": 9, "verdict": verdict()}]})
    return answers, {q for i, q in enumerate(answers) if i % 5}, said


def simulated(answers, served, said, max_claims, max_alone, attempt=0, fuse=True):
    """claims as {(q, no): (state, stage)} and calls as {(q, stage): (calls, failed)}."""
    claims, calls = {}, {}

    def verdicts(payload):
        return None if payload is None else {x["claim_id"]: x["verdict"] for x in json.loads(payload)["verdicts"] if isinstance(x, dict)}

    for q, answer in answers.items():
        if not answer or answer == REFUSAL:
            continue
        if fuse and q in served:
            payload = said.get(("fused", q, 0))
            calls[q, "fused"] = (1, int(payload is None))
            items = [x for x in json.loads(payload)["items"] if "user" not in x["claim"]][:max_claims] if payload else []
            if items:
                claims |= {(q, k): (x["verdict"], "fused") for k, x in enumerate(items, 1)}
                continue
        count = min(max_claims, len(answer.split(". ")))
        found = {}
        for number, stage in enumerate(("batch", "retry")):
            got = verdicts(said.get((f"batch{number}", q, 0)))
            calls[q, stage] = (1, int(got is None))
            if got is not None:
                found = {k: (x, stage) for k, x in got.items() if k <= count}
                break
        refuted = sum(x == "CONTRADICTED" for x, _ in found.values())
        budget = 0 if attempt or refuted > 0.2 * count else max_alone
        for k in range(1, count + 1):
            if k in found:
                claims[q, k] = found[k]
            elif budget:
                budget -= 1
                got = verdicts(said.get(("alone", q, k)))
                done, failed = calls.get((q, "alone"), (0, 0))
                calls[q, "alone"] = (done + 1, failed + (got is None))
                claims[q, k] = (got[9] if got else "NEUTRAL", "alone")
            else:
                claims[q, k] = ("NEUTRAL", "left")
    return claims, calls


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"attempt": 1}), (3, {"fuse": False, "max_claims": 3})])
def test_stages_equal_a_simulation(spark, seed, options):
    answers, served, said = case(seed)
    shown = spark.createDataFrame([(q, 1, "text") for q in served], "query_id string, segment int, text string")
    options = {"max_claims": 5, "max_alone": 2} | options
    claims, calls = v.verify(spark.createDataFrame(list(answers.items()), "query_id string, answer string"), shown, Told(spark, said), **options)
    want_claims, want_calls = simulated(answers, served, said, **options)
    got = {(r.query_id, r.claim_no): (r.state, r.stage) for r in claims.collect()}
    assert got == want_claims
    assert {(r.query_id, r.stage): (r.calls, r.failed) for r in calls.collect()} == want_calls
    assert len(Counter(s for _, s in got.values())) >= 3 - options.get("attempt", 0)


def test_offline_judge_and_empty_tables(spark):
    answers = spark.createDataFrame([(1, "The bank lends money to the small town on the river bend."), (2, None)], "query_id long, answer string")
    served = spark.createDataFrame([(1, 1, "On the river bend the bank lends money to the small town.")], "query_id long, segment int, text string")
    claims, calls = v.verify(answers, served)
    assert [(r.query_id, r.state, r.stage) for r in claims.collect()] == [(1, "SUPPORTED", "fused")]
    claims, calls = v.verify(answers.limit(0), served)
    assert claims.count() == 0 and calls.count() == 0


def test_targeted_retrieval_equals_a_loop(spark):
    texts = {i: f"Chunk {i} tells of topic {i % 7} and topic {i % 4}." for i in range(40)}
    texts[8] = "changed since"
    stored = {i: f"Chunk {i} tells of topic {i % 7} and topic {i % 4}." for i in range(40)}
    rng = random.Random(4)
    judged = [(f"q{q}", k, f"claim {q} {k}", rng.choice(["NEUTRAL", "NEUTRAL", "SUPPORTED", "CONTRADICTED"])) for q in range(12) for k in range(1, 8)]
    results = {(q, k): rng.sample(range(40), 6) for q, k, _, _ in judged}
    seen = {f"q{q}": set(rng.sample(range(40), 8)) for q in range(12)}
    state = lambda claim, text: ["NEUTRAL", "SUPPORTED", "CONTRADICTED"][(len(text) * 7 + sum(map(ord, text + claim))) % 3]

    @F.udf("string")
    def judge_of(claim, text):
        return state(claim, text) if text is not None else None

    want, changed = {(q, k): (s, None) for q, k, _, s in judged}, 0
    for q in dict.fromkeys(q for q, *_ in judged):
        taken = set(seen[q])
        for k in [k for p, k, _, s in judged if p == q and s == "NEUTRAL"][:3]:
            fresh = [i for i in results[q, k][:5] if i not in taken]
            taken |= set(fresh)
            served = [i for i in fresh if texts[i] == stored[i]]
            states = [state(f"claim {q[1:]} {k}", texts[i]) for i in served]
            for s in ("SUPPORTED", "CONTRADICTED"):
                if s in states:
                    # The segments that the judge names are those that aren't neutral.
                    want[q, k], changed = (s, [i for i, x in zip(served, states) if x != "NEUTRAL"]), changed + 1
                    break
    rows = spark.createDataFrame([(q, k, c, s, [1]) for q, k, c, s in judged], "query_id string, claim_no int, claim string, state string, segments array<bigint>")
    found = spark.createDataFrame([(q, k, rank, i, 0, texts[i]) for (q, k), items in results.items() for rank, i in enumerate(items, 1)], "query_id string, claim_no int, rank int, doc_id long, chunk_index int, text string")
    shown = spark.createDataFrame([(q, i, 0, texts[i]) for q, items in seen.items() for i in items], "query_id string, doc_id long, chunk_index int, text string")
    references = spark.createDataFrame(list(stored.items()), "doc_id long, text string").select("doc_id", F.lit(0).alias("chunk_index"), n.text_hash(F.col("text")).alias("text_hash"))
    asked = []

    def search(targets):
        asked.append(targets.count())
        return found.join(targets.select("query_id", "claim_no"), ["query_id", "claim_no"])

    changes = v.rejudged(rows, search, shown, references, judge_of).cache()
    got = {(r.query_id, r.claim_no): (r.state, r.evidence) for r in v.with_changes(rows, changes).collect()}
    assert got == want and changed > 5 and changes.count() == changed
    assert asked[0] == sum(min(3, sum(s == "NEUTRAL" for p, _, _, s in judged if p == q)) for q in {q for q, *_ in judged})
    again = {r.query_id: r[1:] for r in e.claim_summary(v.with_changes(rows, changes)).collect()}
    assert {r.query_id: r[1:] for r in v.summary_by_delta(e.claim_summary(rows), changes).collect()} == again
