"""Repairs against plain Python: all edits of short conversations, and a table of states for long ones."""

import hashlib
import random
import re
from itertools import product

import pytest

from loomscore.llm import conversation_repair as cr

GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """Of rows in order: their first faults."""
    out, seen = [], set()
    for role, text in rows:
        marks = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows):
    """(cost, audit, lines): the least of all edits, with up to two inserts in each gap."""
    gaps = [g for n in range(3) for g in product(("user", "assistant"), repeat=n)]
    marks, best = faults(rows), None
    for edits in product(("D", "K", "user", "assistant"), repeat=len(rows)):
        base, ok = 0, True
        for e, f in zip(edits, marks, strict=True):
            base += 4 if e == "D" else (0 if e == "K" else 3) + 3 * (f == "truncated")
            ok &= e == "D" or f not in ("blank", "duplicate")
        if not ok or best and base > best[0]:
            continue
        for filled in product(gaps, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, filled))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for k, g in enumerate(filled):
                audit += "I" * len(g)
                lines += [(r, "") for r in g]
                if k < len(rows):
                    e, (role, text) = edits[k], rows[k]
                    audit += e if e in "DK" else "R"
                    lines += [] if e == "D" else [(role if e == "K" else e, text)]
            if GOOD.fullmatch("".join(r[:1] for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def table_of_states(rows):
    """The same by states, for long conversations."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def filled(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, lines) in list(out.items()):
                to = turn[s]
                new = (cost + 3, audit + "I", [*lines, (name[to], "")])
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    states = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for s, (cost, audit, lines) in filled(states).items():
            found = [(s, cost + 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                found.append((turn[s], cost + 3 + more, "R", [(name[turn[s]], text)]))
                if role[:1] == turn[s] or role[:1] == "s" and s == "":
                    found.append((role[:1], cost + more, "K", [(role, text)]))
            for to, c, e, line in found:
                if to not in after or (c, audit + e) < after[to][:2]:
                    after[to] = (c, audit + e, lines + line)
        states = after
    ends = filled(states)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])


def expected(turns):
    """Of (turn, role, text) rows: every figure of the operator."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    numbers = [t for t, _, _ in rows if t is not None]
    rows = [(r, x) for _, r, x in rows]
    marks = faults(rows)
    cost, audit, lines = table_of_states(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(f"{r}:{x}" for r, x in lines)


def got(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string").selectExpr("*", "1 AS block", "'x' AS audit", "2 AS place")
    found = cr.faults(df)
    audited = cr.audits(found).cache()
    repaired = cr.repaired(df, audited)
    summary = {r["conv_id"]: tuple(r)[1:] for r in cr.summary(found).collect()}
    audits = {r["conv_id"]: tuple(r)[1:] for r in audited.collect()}
    digests = {r["conv_id"]: r["sha256"] for r in cr.digests(repaired).collect()}
    lines = {}
    for r in repaired.collect():
        lines.setdefault(r["conv_id"], []).append(r)
    assert set(summary) == set(audits) == set(digests)
    out = {}
    for c in summary:
        kept = [r for r in lines.get(c, []) if r["place"] is not None]
        assert [r["place"] for r in kept] == list(range(len(kept)))
        assert "".join(r["edit"] for r in lines.get(c, [])) == audits[c][2]
        text = "\n".join(f"{r['role']}:{r['text']}" for r in kept)
        assert digests[c] == hashlib.sha256(text.encode()).hexdigest()
        out[c] = (*summary[c], *audits[c], text)
    return out


ROLES = ["user", "assistant", "system", "tool", None, "", "s", "aide", "User"]
TEXTS = ["Yes.", "No", "", " \n", None, "What?", "x! ", "cut off, ", "é…", "日本。", "ok. ", "a?\x0b"]


def conversation(r, n):
    return [(r.choice([None, *range(-2, n)]) if r.random() < 0.2 else t, r.choice(ROLES[: r.choice((2, 3, 9))]), r.choice(TEXTS) if r.random() < 0.5 else f"t{r.randint(0, 9)}.") for t in range(n)]


def test_the_two_plain_versions_agree():
    r = random.Random(5)
    for _ in range(60):
        rows = [(x or " ", t or " ") for _, x, t in conversation(r, r.randint(0, 3))]
        assert table_of_states(rows) == all_edits(rows)


@pytest.mark.parametrize(("piece", "block", "batch"), [(32, 5, 10_000), (3, 1, 7)])
def test_repairs_equal_plain_version(spark, monkeypatch, piece, block, batch):
    monkeypatch.setattr(cr, "PIECE", piece)
    monkeypatch.setattr(cr, "BLOCK", block)
    r = random.Random(piece)
    convs = {c: conversation(r, r.choice((1, 2, 3, 4, 6, 9, 30))) for c in range(120 if piece > 3 else 30)} | {None: conversation(r, 8), 500: conversation(r, 700 if piece > 3 else 60), 501: [(3, "user", "Same.")] * 40}
    rows = [(c, *t) for c, turns in convs.items() for t in turns]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = got(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {c: expected(t) for c, t in convs.items()}


def test_very_long_texts_text_ids_and_empty_tables(spark):
    long = "word " * 200_000
    rows = [("a", 0, "user", long), ("a", 1, "assistant", long + "."), ("é", 7, "assistant", "Hi."), ("", 2**62, "user", "x."), ("", -(2**62), "user", "x.")]
    found = got(spark, rows, "string")
    assert found == {c: expected([t for d, *t in rows if d == c]) for c in ("a", "é", "")}
    assert got(spark, []) == {}
