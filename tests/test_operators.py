import hashlib
import hmac
import json
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import text as X
from veilframe.operators import cases as C
from veilframe.operators import gate as G
from veilframe.operators import invariance as I
from veilframe.operators import leaks as L
from veilframe.operators import proposals as P
from veilframe.operators import swaps as W
from veilframe.operators import uniqueness as U
from veilframe.plans.audit import audit_leaks, verify
from veilframe.sources.tables import read_cases, write_cases
from veilframe.streaming.stream import audit_stream

SCHEMA = C.CaseSchema.of({"person": C.IDENTIFYING, "team": C.CONTEXTUAL, "weeks": C.DECISION, "reason": C.DECISION})
COLUMNS = "case_id bigint, person string, team string, weeks int, reason string, narrative string"


def cases(spark, *rows):
    return C.as_cases(spark.createDataFrame(list(rows), COLUMNS), SCHEMA)


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_fold_and_tokens(spark):
    texts = ["José ﬁne STRASSE ß", "naïve_x-y", "ΑΣ Ǆ ½", "日本 café", "", None, "ͅx İ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold(F.col("t")).alias("f"), X.tokenize(F.col("t")).alias("w"))
    for r in df.collect():
        assert r.f == (None if r.t is None else X.fold_text(r.t))
        assert r.t is None or "ͅ" in r.t or r.w == re.findall(r"[^\W_]+", X.fold_text(r.t))


def test_substitution(spark):
    df = spark.createDataFrame([("Ann met ann; Anna and Ann Lee.",), ("",), (None,)], "t string")
    table = {"ann": "Bea", "Ann Lee": "Eve", "Bea": "Zoe"}
    assert one(df, X.substitute(F.col("t"), table)) == [("Bea met Bea; Anna and Eve.",), ("",), (None,)]
    assert one(df.limit(1), X.substitution_counts(F.col("t"), table))[0][0] == {"ann": 2, "ann lee": 1}
    assert one(df.limit(1), X.substitute(F.col("t"), {})) == [("Ann met ann; Anna and Ann Lee.",)]
    own = df.withColumn("m", F.create_map(F.lit("ann"), F.lit("Bea")))
    assert one(own.limit(1), X.substitute_by_row(F.col("t"), F.col("m"))["text"]) == [("Bea met Bea; Anna and Bea Lee.",)]
    with pytest.raises(X.SubstitutionConflict):
        X.substitution_table({"a": "x", "A": "y"})


def test_cases(spark, tmp_path):
    df = cases(spark, (1, "Ann", None, 3, "flu", "Story."))
    with pytest.raises(ValueError):
        C.as_cases(df.drop("team"), SCHEMA)
    with pytest.raises(ValueError):
        C.CaseSchema.of({"x": "secret"})
    with pytest.raises(KeyError):
        SCHEMA.retag({"nope": C.DECISION})
    with pytest.raises(KeyError):
        C.with_values(df, SCHEMA, {"nope": F.lit(1)})
    assert C.schema_of(C.with_values(df, SCHEMA, {"weeks": F.lit(4)})) == SCHEMA
    assert C.decision_view(df, SCHEMA).columns == ["case_id", "weeks", "reason"]
    assert one(df, C.render(df, SCHEMA)) == [("Story.\n\nperson: Ann\nteam: None\nweeks: 3\nreason: flu",)]
    assert [r.source for r in C.text_sources(df, SCHEMA).orderBy("pos").collect()] == [C.NARRATIVE, "person", "weeks", "reason"]
    base, other = C.with_digest(df, SCHEMA), C.with_digest(df, C.CaseSchema(SCHEMA.roles[::-1]))
    assert one(base, "digest") == one(other, "digest") != one(C.with_digest(df, SCHEMA.retag({"team": C.DECISION})), "digest")
    text = one(df, C.canonical_text(df, SCHEMA))[0][0]
    assert one(C.with_keyed_digest(df, SCHEMA, b"k"), "digest")[0][0] == hmac.new(b"k", text.encode(), hashlib.sha256).hexdigest()
    write_cases(df, SCHEMA, str(tmp_path / "c"))
    assert read_cases(spark, str(tmp_path / "c"))[1] == SCHEMA


POLICIES = {"leave": lambda f: F.when(f("weeks") >= 6, "long").when(f("reason") == "medical", "short").otherwise("none")}


def test_invariance_and_probe(spark):
    o, a = cases(spark, (1, "Ann", "x", 7, "medical", ""), (2, "Bob", "x", 2, "medical", "")), cases(spark, (1, "Eve", "y", 8, "medical", ""), (2, "Kim", "y", 2, "other", ""))
    report = {r.case_id: (r.passed, r.failures) for r in I.invariance_report(I.check_invariance(o, a, POLICIES)).collect()}
    assert report == {1: (True, ""), 2: (False, "leave")}
    broken = I.check_invariance(o, a, {"bad": I.python_policy(lambda w: 1 // 0, "weeks")})
    assert {r.error.split(":")[0] for r in broken.collect()} == {"ZeroDivisionError"} and not any(r.equivalent for r in broken.collect())
    with pytest.raises(ValueError):
        I.check_invariance(o, a, {})
    tries = spark.createDataFrame([("weeks", "1"), ("weeks", "7"), ("weeks", "1"), ("reason", "other")], "field string, v string")
    probes = {(r.case_id, r.field): (r.probed_values, r.n_flips) for r in I.sensitivity_probe(o, SCHEMA, POLICIES, tries, a).collect()}
    assert probes[1, "weeks"] == (2, 1) and probes[1, "person"] == (1, 0) and probes[2, "reason"] == (1, 1) and probes[1, "reason"] == (1, 0)
    none = I.sensitivity_report(I.sensitivity_probe(o, SCHEMA, POLICIES))
    assert {r.unprobed for r in none.collect()} == {"person,team,weeks,reason"}


def test_probe_counts_errors_of_python_policies(spark):
    def decide(weeks, reason):
        if reason == "other":
            raise KeyError("a: b")
        return 12 // weeks

    o = cases(spark, (1, "Ann", "x", 3, "flu", ""), (2, "Bob", "x", 0, "flu", ""), (3, "Kim", "x", 4, "flu", ""))
    tries = spark.createDataFrame([("weeks", "0"), ("weeks", "4"), ("reason", "other"), ("reason", "cold"), ("team", "y")], "field string, v string")
    own = {"own": lambda f: F.struct(F.lit("x").alias("outcome"), F.when(f("weeks") == 0, "ZeroDivisionError: z").alias("error"))}
    found = I.sensitivity_probe(o, SCHEMA, {"python": I.python_policy(decide, "weeks", "reason")} | POLICIES | own, tries)
    got = {(r.case_id, r.policy, r.field): (r.probed_values, r.n_flips, [tuple(x) for x in r.flips]) for r in found.collect()}
    assert len(got) == 36
    assert got[1, "python", "weeks"] == (2, 2, [("0", "<error: ZeroDivisionError>"), ("4", "3")])
    assert got[1, "python", "reason"] == (2, 1, [("other", "<error: KeyError>")]) and got[1, "python", "team"] == (1, 0, [])
    assert all(got[2, p, f] == (0, 0, []) for p in ("python", "own") for f in SCHEMA.names) and got[2, "leave", "weeks"] == (1, 0, [])
    assert got[3, "own", "weeks"] == (1, 1, [("0", "<error: ZeroDivisionError>")])
    report = {(r.case_id, r.policy): (r.flipping, r.unprobed) for r in I.sensitivity_report(found).collect()}
    assert report[1, "python"] == ("weeks,reason", "person") and report[2, "python"] == ("", "person,team,weeks,reason")


def leaks_by_hand(o, a):
    """Row-wise version of the audit for one pair, with default settings."""
    tok = lambda t: re.findall(r"[^\W_]+", X.fold_text(t))
    src = lambda c: ([(C.NARRATIVE, c["narrative"])] if c["narrative"] else []) + [(n, str(c[n])) for n in SCHEMA.names if c[n] is not None]
    hay, out = [tok(t) for _, t in src(a)], {}
    union = {t for h in hay for t in h}
    ok = {t for n in SCHEMA.with_role(C.DECISION) if o[n] is not None for t in tok(str(o[n]))}
    held = lambda run: any(h[i : i + len(run)] == run for h in hay for i in range(len(h) - len(run) + 1))
    use = lambda t: len(t) >= 2 and t not in X.STOPWORDS
    for source, text in src(o):
        w, role = tok(text), dict(SCHEMA.roles).get(source)
        if not w:
            continue
        if source != C.NARRATIVE and held(w):
            fine = all(t in ok or t in X.STOPWORDS for t in w)
            out[source, "field_value", " ".join(w)] = (3 if role == C.IDENTIFYING else 2, role == C.DECISION or fine)
        elif role == C.IDENTIFYING:
            out |= {(source, "identifying_token", t): (3, t in ok) for t in w if use(t) and t in union}
        else:
            # all runs that the other side holds and that cannot go on, then the leftmost that count and do not overlap
            runs = [(p, q) for p in range(len(w)) for q in range(p + 2, len(w) + 1) if held(w[p:q]) and (q == len(w) or not held(w[p : q + 1]))]
            taken, covered = [], set()
            for p, q in runs:
                if (not taken or p >= taken[-1][1]) and len([t for t in w[p:q] if use(t)]) >= 2:
                    taken.append((p, q))
            for p, q in taken:
                covered |= set(w[p:q])
                out.setdefault((source, "phrase", " ".join(w[p:q])), (2, all(t in ok or t in X.STOPWORDS or len(t) < 2 for t in w[p:q])))
            out |= {(source, "token", t): (1, t in ok) for t in w if use(t) and t in union and t not in covered}
    return out


WORDS = st.lists(st.sampled_from("ann lee the of red blue q3 x team long".split()), max_size=7).map(" ".join)
FIELDS = st.fixed_dictionaries({"person": WORDS, "team": WORDS, "weeks": st.integers(0, 9), "reason": WORDS, "narrative": WORDS})


@given(st.lists(st.tuples(FIELDS, FIELDS), min_size=6, max_size=12))
@settings(max_examples=5, deadline=None)
def test_leaks_match_the_row_wise_audit(spark, pairs):
    table = lambda k: cases(spark, *[(i, *[p[k][n] for n in (*SCHEMA.names, "narrative")]) for i, p in enumerate(pairs)])
    got = {}
    for r in L.find_leaks(table(0), table(1), SCHEMA).collect():
        got[r.case_id, r.source, r.kind, r.text] = (r.severity, r.allowed)
    expected = {(i, *k): v for i, (o, a) in enumerate(pairs) for k, v in leaks_by_hand(o, a).items()}
    assert got == expected


def test_leak_options(spark):
    o, a = cases(spark, (1, "José", "Q3 crew", 3, "flu", "")), cases(spark, (1, "jose x", "q3", 3, "cold", ""))
    assert [r.text for r in L.find_leaks(o, a, SCHEMA).where("severity = 3").collect()] == ["jose"]
    assert one(L.leak_report(a, L.find_leaks(o, a, SCHEMA, allow=["José"])), "n_blocking") == [(0,)]
    with pytest.raises(TypeError):
        L.find_leaks(o, a, SCHEMA, allow="José")
    assert one(audit_leaks(o, a, SCHEMA), "uniqueness_assessed", "passed") == [(False, False)]


def _staff_log():
    """An own population: a small office and a depot over four seasons, drawn by rule."""
    out = []
    for i in range(83):
        place = ("office", "depot", "yard")[i * i % 3]
        out.append((place, f"season {i % 4}", (i * 7) % 5 + 1, "rest" if i % 6 else "care", ("back", "eye", "none")[i % 3]))
    return out


@pytest.mark.parametrize("analogue", [("depot", "season 1", 3, "rest", "eye"), ("office", "season 0", 1, "care", "back"), ("yard", "season 9", 2, "rest", "none")])
@pytest.mark.parametrize("condition", [False, True])
def test_scopes_on_a_small_log(spark, analogue, condition):
    """k by counting, with the condition among the quasi-identifiers or not; a shared value need not be the original's neighbour."""
    log, original = _staff_log(), ("office", "season 0", 3, "rest", "eye")
    kinds = "place string, season string, months int, reason string, condition string"
    pair = [spark.createDataFrame([(1, *x)], "case_id bigint, " + kinds) for x in (original, analogue)]
    schema = C.CaseSchema.of({"place": C.CONTEXTUAL, "season": C.CONTEXTUAL, "months": C.DECISION, "reason": C.DECISION, "condition": C.DECISION if condition else C.IDENTIFYING})
    found = {r.scope: r for r in U.estimate_uniqueness(*pair, spark.createDataFrame(log, kinds), schema).collect()}
    used = range(5 if condition else 4)
    count = lambda fields, case: sum(all(r[f] == case[f] for f in fields) for r in log)
    agree = [f for f in used if original[f] == analogue[f]]
    assert found["analogue"].k == count(used, analogue) and found["original"].k == count(used, original)
    assert found["shared_with_original"].k == count(agree, original) and len(found["shared_with_original"].quasi_identifiers) == len(agree)
    assert found["analogue"].flagged == (0 < count(used, analogue) < 5) and not found["original"].flagged


def test_uniqueness_edges(spark):
    log = spark.createDataFrame([(" Red ", 1.0, ["a", "b"]), ("RÉD", float("nan"), ["a", "b"]), (None, 2.0, ["a", "b"]), ("red", 1.0, ["a"])], "a string, b double, _present array<string>")
    own = spark.createDataFrame([(1, "red", 1.0), (2, None, 2.0), (3, "red", float("nan"))], "case_id bigint, a string, b double")
    assert sorted(one(U.count_matches(own, log, ["a"]), "case_id", "k")) == [(1, 3), (2, 1), (3, 3)]
    assert sorted(one(U.count_matches(own, log, ["a", "b"]), "case_id", "k")) == [(1, 1), (2, 1), (3, 0)]
    assert sorted(one(U.count_matches(own, log, []), "case_id", "k")) == [(1, 4), (2, 4), (3, 4)]
    near = {"b": lambda r, c: F.abs(r - c) <= 1}
    scopes = U.estimate_uniqueness(own.limit(1), own.limit(1), log, C.CaseSchema.of({"a": C.CONTEXTUAL, "b": C.CONTEXTUAL}), matchers=near)
    assert {r.scope: r.k for r in scopes.collect()}["shared_with_original"] == 1
    with pytest.raises(ValueError):
        U.check_inputs(own, own, log.limit(0), ["a"])
    with pytest.raises(ValueError):
        U.check_inputs(own, own, log, ["zz"])


def test_swaps(spark):
    df = cases(spark, (1, "ANN", "crew", 3, "flu", "Ann of crew has flu."), (2, "Bob", "crew", 3, "flu", ""))
    swapper = W.RuleBasedTransformer({"person": {"Ann": "Eve"}, "team": {"crew": "staff"}}, {"flu": "cold"})
    rows = {r.case_id: r for r in swapper.transform(df, SCHEMA).collect()}
    assert (rows[1].person, rows[1].team, rows[1].narrative) == ("Eve", "staff", "Eve of staff has cold.")
    assert rows[1].mapping == {"Eve": "ANN", "staff": "crew", "cold": "flu"} and rows[2].error.endswith("person") and rows[2].mapping is None
    clash = W.RuleBasedTransformer({"person": {"Ann": "X", "Bob": "X"}, "team": {"crew": "x"}}).transform(df, SCHEMA)
    assert {r.error for r in clash.collect()} == {"mapping conflict"}


def test_proposals(spark):
    good = json.dumps({"fields": {"person": "Eve", "team": "t", "weeks": "3", "reason": "flu"}, "narrative": "Eve", "replacements": [["Ann", "Eve"], ["zz", "yy"], "bad"]})
    old = {"person": "Ann", "team": "crew", "weeks": 3, "reason": "flu"}
    new, story, mapping, warnings = P.parse_reply(good, old, "Ann")
    assert new["weeks"] == 3 and story == "Eve" and mapping == {"Eve": "Ann", "t": "crew"} and len(warnings) == 2
    for bad in ("x", "[]", '{"fields": {}}', good.replace('"3"', "true"), good.replace('"Eve"', "1", 1)):
        with pytest.raises(P.ReplyError):
            P.parse_reply(bad, old, "Ann")
    with pytest.raises(P.ReplyError):
        P.LocalModelTransformer("m", "http://example.org")
    model = P.LocalModelTransformer("m", post=lambda url, body, timeout: {"message": {"content": good}} if "Ann" in body["messages"][1]["content"] else {})
    rows = {r.case_id: r for r in model.transform(cases(spark, (1, "Ann", "crew", 3, "flu", "Ann"), (2, "Bob", "crew", 3, "flu", "")), SCHEMA).collect()}
    assert rows[1].person == "Eve" and rows[1].error is None and rows[2].error.startswith("KeyError")


def test_gate(spark, tmp_path):
    o, a = cases(spark, (1, "Ann", "x", 7, "m", ""), (2, "Bob", "x", 7, "m", "")), cases(spark, (1, "Eve", "y", 7, "m", ""), (2, "Kim", "y", 7, "m", ""))
    records = G.new_records(o, a, SCHEMA, b"key")
    assert one(records.where("original_digest = original_fp"), "case_id") == []
    with pytest.raises(ValueError):
        G.sign_off(records, "  ", True)
    signed = G.signoff_status(records, G.sign_off(records, "r", False, at="1").unionByName(G.sign_off(records.where("case_id = 1"), "r", True, "n", "2")))
    assert sorted(one(signed, "case_id", "signoff")) == [(1, "approved"), (2, "rejected")]
    changed = C.with_values(a, SCHEMA, {"team": F.lit("z")})
    stale = G.signoff_status(G.new_records(o, changed, SCHEMA), G.sign_off(records, "r", True))
    assert {r.signoff for r in stale.collect()} == {"stale"}
    fine = spark.createDataFrame([(1, True, "", 0, 0), (2, False, "p", 2, 1)], "case_id bigint, passed boolean, failures string, n_blocking bigint, n_flagged bigint")
    cleared = G.clear(signed, fine, fine, fine)
    assert {r.case_id: list(r.reasons) for r in cleared.collect()} == {1: [], 2: ["invariance failed: p", "direct leaks: 2", "uniqueness flags: 1", "sign-off rejected"]}
    assert {r.reasons[-1] for r in G.clear(signed.where("case_id = 1"), fine, fine).collect()} == {"uniqueness not assessed"}
    foreign = G.clear(signed.where("case_id = 1"), fine.withColumn("analogue_digest", F.lit("other")), fine, fine)
    assert one(foreign, "reasons")[0][0] == ["invariance report is for another case"]
    sent, log = [], str(tmp_path / "log")
    answers = G.release(cleared, a, SCHEMA, lambda text: sent.append(text) or "Eve is fine", log, "Why?")
    assert one(answers, "case_id", "answer") == [(1, "Eve is fine")] and len(sent) == 1 and sent[0].startswith(G.NOTICE + "\n\nWhy?\n\nperson: Eve")
    assert G.release(cleared, a, SCHEMA, sent.append, log).count() == 1 and len(sent) == 1  # answered already
    assert G.release(cleared, changed, SCHEMA, sent.append, str(tmp_path / "other")).count() == 0 and len(sent) == 1
    assert {r.case_id: list(r.reasons) for r in G.refusals(cleared, changed, SCHEMA).collect()} == {1: ["analogue changed since clearance"], 2: ["status refused", "analogue changed since clearance", "sign-off rejected"]}
    mappings = spark.createDataFrame([(1, {"Eve": "Ann", "Kim Lee": "Bob"}), (9, {"fine": "x"})], "case_id bigint, mapping map<string,string>")
    own = answers.withColumn("answer", F.lit("EVE, lee and Evelyn")).unionByName(answers.withColumn("case_id", F.lit(2).cast("bigint")))
    rows = sorted(one(G.back_map_by_case(own, mappings), "case_id", "back_mapped", "replacements", "residue"))
    assert rows == [(1, "Ann, lee and Evelyn", {"eve": 1}, ["lee"]), (2, "Eve is fine", {}, [])]
    assert "original_fp" not in G.shareable(cleared).columns and "note" not in G.shareable(cleared).columns and "note" in G.local_view(cleared).columns
    back = answers.select(G.back_map(F.col("answer"), {"Eve": "Ann"}).alias("t"))
    assert one(back, "t", G.residue(F.lit("eve and ann"), {"Eve Lee": "Ann Lee"})) == [("Ann is fine", ["eve"])]


def test_from_audit_to_answer(spark, tmp_path):
    """Originals, proposed analogues, audit, clearance, release and the way back, over own cases of which each fails in another way."""
    people = [(1, "Ann Berg"), (2, "Bob Hale"), (3, "Kim Osei"), (4, "Lea Wolf"), (5, "Tom Reyes")]
    originals = cases(spark, *[(i, n, "north", 7, "medical", f"{n} of north was away.") for i, n in people])
    new = {1: ("Eve Stone", "south", 8, "medical"), 2: ("Bob Stone", "south", 8, "medical"), 3: ("Ida Field", "south", 2, "other"), 4: ("Una Hart", "north", 7, "medical"), 5: ("Max Lind", "west", 9, "medical")}
    analogues = cases(spark, *[(i, *new[i], f"{new[i][0]} of {new[i][1]} was away.") for i, _ in people])
    # a crowd in the south, four in the north and nobody in the west
    population = spark.createDataFrame([("south", 8, "medical")] * 10 + [("south", 2, "other")] * 6 + [("north", 7, "medical")] * 4, "team string, weeks int, reason string")
    options = {"allow": ["was away", "of"]}
    audit = {r.case_id: r for r in audit_leaks(originals, analogues, SCHEMA, population, **options).collect()}
    scopes = {(r.case_id, r.scope): (r.k, r.flagged) for r in U.estimate_uniqueness(originals, analogues, population, SCHEMA).collect()}
    assert scopes[1, "analogue"] == (10, False) and scopes[5, "analogue"] == (0, False) and scopes[4, "analogue"] == (4, True)
    assert scopes[5, "shared_with_original"] == (14, False) and scopes[1, "original"] == (4, False)
    assert [audit[i].passed for i in range(1, 6)] == [True, False, True, False, True]
    records = G.new_records(originals, analogues, SCHEMA, b"key")
    signoffs = G.sign_off(records.where("case_id <> 5"), "Kim", True, at="1").unionByName(G.sign_off(records.where("case_id = 5"), "Kim", False, at="1"))
    final = verify(originals, analogues, SCHEMA, POLICIES, records, signoffs, population, **options)
    reasons = {r.case_id: [x.split(":")[0] for x in r.reasons] for r in final.collect()}
    assert reasons[1] == [] and reasons[3] == ["invariance failed"] and reasons[5] == ["sign-off rejected"]
    assert "direct leaks" in reasons[2] and "uniqueness flags" in reasons[4]
    sent = []
    log = G.release(final, analogues, SCHEMA, lambda text: sent.append(text) or "Eve Stone may go; ask EVE STONE.", str(tmp_path / "log"), "May they go?")
    assert len(sent) == 1 and "Ann" not in sent[0] and {r.case_id for r in G.refusals(final, analogues, SCHEMA).collect()} == {2, 3, 4, 5}
    pairs = C.string_pairs(originals, analogues, SCHEMA).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("analogue", "original"))).alias("mapping"))
    back = G.back_map_by_case(log, pairs).first()
    assert back.back_mapped == "Ann Berg may go; ask Ann Berg." and back.replacements == {"eve stone": 2} and back.residue == []
    assert not {"mapping", "note", "original_fp"} & set(G.shareable(final).columns)


def test_requests_are_repeated(spark):
    def post(url, body, timeout):
        post.calls = getattr(post, "calls", 0) + 1
        if post.calls < 3:
            raise OSError("busy")
        return {"message": {"content": '{"fields": {"person": "Eve", "team": "t", "weeks": 3, "reason": "flu"}}'}}

    df = cases(spark, (1, "Ann", "crew", 3, "flu", ""))
    assert P.LocalModelTransformer("m", post=post, pause=0).transform(df, SCHEMA).first().person == "Eve"
    assert P.LocalModelTransformer("m", post=post, retries=1, pause=0).transform(df, SCHEMA).first().error == "OSError: busy"


def test_a_failing_send_keeps_the_answers_before_it(spark, tmp_path):
    pair = [cases(spark, *[(i, n, "x", 7, "m", "") for i in range(5)]) for n in ("Ann", "Eve")]
    records = G.new_records(*pair, SCHEMA).withColumns({"status": F.lit("cleared"), "signoff": F.lit("approved")})
    sent = []

    def send(text):
        if len(sent) == 3:
            raise OSError("no line")
        sent.append(text)
        return str(len(sent))

    with pytest.raises(OSError):
        G.release(records, pair[1], SCHEMA, send, str(tmp_path / "log"), batch=2)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    sent.append("more")
    assert G.release(records, pair[1], SCHEMA, send, str(tmp_path / "log"), batch=2).count() == 5 and len(sent) == 6


def test_equivalences_and_missing_analogues_fail_closed(spark):
    o, a = cases(spark, (1, "Ann", "x", 7, "m", ""), (2, "Bob", "x", 3, "m", "")), cases(spark, (1, "Eve", "y", 7, "m", ""))

    def same(x, y):
        raise KeyError("no")

    found = I.check_invariance(o, a, {"weeks": lambda f: f("weeks")}, I.python_equivalence(same))
    rows = {r.case_id: (r.original_outcome, r.equivalent, r.error) for r in found.collect()}
    assert rows == {1: ("7", False, "equivalence raised KeyError: 'no'"), 2: (None, False, "no analogue")}


def test_digests_tell_close_doubles_apart(spark):
    schema = C.CaseSchema.of({"x": C.DECISION})
    values = [1e-11, 2e-11, 0.1, 0.30000000000000004, 0.3, 1e16, 12345678.5, -0.0, 0.0, 1e-4, 9.999e-5, float("nan"), float("inf"), 1.5e300, None]
    df = C.as_cases(spark.createDataFrame(list(enumerate(values)), "case_id bigint, x double"), schema)
    digests = [r.digest for r in C.with_digest(df, schema).orderBy("case_id").collect()]
    assert len(set(digests)) == len(values)
    texts = [r.t for r in df.select("case_id", C.text_of(F.col("x"), df.schema["x"].dataType).alias("t")).orderBy("case_id").collect()]
    assert texts == [None if v is None else repr(v) for v in values]


def test_numbers_have_the_fewest_digits_everywhere(spark):
    schema = C.CaseSchema.of({"x": C.DECISION, "y": C.CONTEXTUAL})
    rows = [(1, 5.39939e20, 0.1), (2, 2e23, 1e-5), (3, None, None), (4, float("nan"), float("-inf")), (5, 5e-324, 16777216.0)]
    df = C.as_cases(spark.createDataFrame(rows, "case_id bigint, x double, y float"), schema)
    texts = {1: ("5.39939e+20", "0.1"), 2: ("2e+23", "1e-05"), 3: (None, None), 4: ("nan", "-inf"), 5: ("5e-324", "16777216.0")}
    long = {(r.case_id, r.field): r.v for r in C.to_long(df, schema).collect()}
    assert long == {(k, f): t for k, both in texts.items() for f, t in zip("xy", both)}
    assert {r.case_id: r.t for r in df.select("case_id", C.render(df, schema).alias("t")).collect()} == {k: f"x: {x}\ny: {y}" for k, (x, y) in texts.items()}
    assert C.text_sources(df, schema).count() == 8
    quoted, bare = ({r.case_id: r.t for r in df.select("case_id", C.to_json(df, schema, typed=True, bare=b).alias("t")).collect()} for b in (False, True))
    assert quoted[4] == bare[4].replace("nan", '"nan"').replace("-inf", '"-inf"') and quoted[1] == bare[1]
    assert [f["value"] for f in json.loads(quoted[5])["fields"]] == [5e-324, 16777216.0]


def test_swap_tables_fold_both_sides(spark):
    df = cases(spark, (1, "Groß", "crew", 3, "flu", ""), (2, "GROSS", "crew", 3, "flu", ""))
    rows = W.RuleBasedTransformer({"person": {"Groß": "Klein"}}).transform(df, SCHEMA).collect()
    assert {r.person for r in rows} == {"Klein"} and not any(r.error for r in rows)
    with pytest.raises(X.SubstitutionConflict):
        W.RuleBasedTransformer({"person": {"Groß": "a", "gross": "b"}}).transform(df, SCHEMA)


def test_odd_replies_fail_alone(spark):
    old, roles = {"person": "Ann", "team": "crew", "weeks": 3, "reason": "flu"}, dict(SCHEMA.roles)
    reply = lambda **x: json.dumps({"fields": {"person": "Eve", "team": "t", "weeks": 3, "reason": "flu"} | x.pop("fields", {}), "narrative": "n"} | x)
    for bad in (reply(replacements=5), reply(fields={"weeks": float("inf")}), reply(narrative=3), "[" * 100_000):
        with pytest.raises(P.ReplyError):
            P.parse_reply(bad, old, "Ann", roles)
    warned = P.parse_reply(reply(fields={"person": "Ann", "weeks": 4}, narrative=""), old, "Ann", roles)[3]
    assert warned == ["identifying field unchanged: person", "decision-relevant field changed: weeks", "the narrative is missing"]
    odd = C.CaseSchema.of({"a b": C.IDENTIFYING, "class": C.DECISION})
    df = C.as_cases(spark.createDataFrame([(1, "Ann", None), (2, "Bob", 4)], "case_id bigint, `a b` string, class int"), odd)
    model = P.LocalModelTransformer("m", post=lambda url, body, timeout: {"message": {"content": '{"fields": {"a b": "Eve", "class": %s}}' % ("null" if "Ann" in body["messages"][1]["content"] else '"x"')}})
    rows = {r.case_id: r for r in model.transform(df, odd).collect()}
    assert (rows[1]["a b"], rows[1]["class"], rows[1].error) == ("Eve", None, None) and "no int" in rows[2].error


def test_audit_summaries_and_inputs(spark):
    o, a = cases(spark, (1, "Ann", "red", 7, "m", "")), cases(spark, (1, "Eve", "red", 7, "m", ""))
    log = spark.createDataFrame([("red", 7, "m")], "team string, weeks int, reason string")
    row = audit_leaks(o, a, SCHEMA, log).first()
    assert row.analogue_digest == one(C.with_digest(a, SCHEMA), "digest")[0][0] and row.original_digest != row.analogue_digest
    assert row.summary.split("\n")[0] == "leak audit: FAIL" and "  medium field_value in team: red" in row.summary and "  analogue on (team, weeks, reason): k = 1 FLAGGED" in row.summary
    assert audit_leaks(o, a, SCHEMA).first().summary.endswith("uniqueness: NOT ASSESSED")
    assert audit_leaks(o, a, SCHEMA, log, matchers={"weeks": lambda r, c: r > c}).first().n_flagged == 1
    with pytest.raises(ValueError, match="no record"):
        U.check_inputs(o, a, log.withColumn("_present", F.array(F.lit("team"))), ["team", "weeks"])
    assert SCHEMA.column(o, "team") is not None and "team" in SCHEMA and "zz" not in SCHEMA
    with pytest.raises(KeyError, match="there are"):
        SCHEMA.role_of("zz")


def test_long_texts_are_searched_in_linear_time(spark):
    words = " ".join(f"w{i * i % 5}" for i in range(16_000))
    df = cases(spark, (1, "Ann", "crew", 3, "flu", words))
    began = time.time()
    assert L.find_leaks(df, df, SCHEMA).where("kind = 'phrase'").count() == 1
    assert time.time() - began < 60


def test_public_names():
    import veilframe

    assert all(getattr(veilframe, n) is not None for n in veilframe.__all__)


def test_stream(spark, tmp_path):
    rows = [(1, "Ann", "x", 7, "m", "")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
    query = audit_stream(source, lambda b: L.find_leaks(C.as_cases(b, SCHEMA), C.as_cases(b, SCHEMA), SCHEMA), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {"ann", "7"}
