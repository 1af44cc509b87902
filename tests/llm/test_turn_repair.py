"""Repair by generalised LR parsing against brute force over all edits, in one stretch and in many."""

import hashlib
import random
import re
import zlib

from passagekit.llm import turn_repair as repair

BLANK = " \t\n\x0b\x0c\r"
WHOLE = re.compile(r"(s?(ua)+)?")
BEGUN = re.compile(r"s?(ua)*u?")


def cheapest(rows):
    """The least (cost, audit, turns) over all edits, by trying them; rows are (role, text, fault)."""
    best = None

    def go(i, cost, audit, turns, inserted):
        nonlocal best
        text = "".join(role[:1] or "?" for role, _ in turns)
        if (best and cost > best[0]) or not BEGUN.fullmatch(text):
            return
        if i == len(rows) and WHOLE.fullmatch(text):
            best = min(best or (cost, audit, turns), (cost, audit, turns))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*turns, (role, "")], inserted + 1)
        if i < len(rows):
            role, text_, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", turns, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                go(i + 1, cost + more, audit + "K", [*turns, (role, text_)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, audit + "R", [*turns, (new, text_)], 0)

    go(0, 0, "", [], 0)
    return best


def brute_force(rows):
    """Reports by conversation, from the text of the contract."""
    seen_ids, left = {}, {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        seen_ids.setdefault(conv, None)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        left.setdefault(conv, []).extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv in seen_ids:
        turns = sorted(
            left.get(conv, []),
            key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()),
        )
        numbers = [t[0] for t in turns if t[0] is not None]
        judged, seen = [], set()
        for _, role, text in turns:
            bare = text.translate({ord(c): None for c in BLANK})
            fault = (
                "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            )
            seen.add((role, text))
            judged.append((role, text, fault))
        initials = [role[:1] for role, _, _ in judged]
        cost, audit, kept = cheapest(judged)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(sum(f == kind for _, _, f in judged) for kind in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def results(spark, tmp_path, rows):
    schema = "conv_id long, turn long, role string, text string, copies string"
    path = str(tmp_path / f"c{len(rows)}")
    spark.createDataFrame([(*r, "own") for r in rows], schema).write.parquet(f"{path}/conversations.parquet")
    found = repair.query(spark, path).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    result = {r.conv_id: tuple(r[n] for n in names) for r in found}
    assert len(result) == len(found)
    return result


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = ["Fine.", "Fine.", "Yes!", "cut off", "", " \n", "no end", "Ä?", "\u3000", None]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rng.randrange(6)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice(texts)))
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(6)]
    rows += [(901, 1, "user", "Same.")] * 4
    assert results(spark, tmp_path, rows) == brute_force(rows)
    assert results(spark, tmp_path, []) == {}


def test_query_equals_brute_force_on_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    wanted = brute_force(rows)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r.conv_id: tuple(r[n] for n in names) for r in repair.query(spark, sf_dir).collect()} == wanted


def test_a_long_conversation_in_stretches_equals_one_stretch(spark):
    rng = random.Random(8)
    rows = [
        (conv, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["Good.", f"Text {turn}.", "open", " "]))
        for conv, n in ((1, 3000), (2, 7), (3, 500))
        for turn in range(n)
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def found(stretch):
        reports, repaired = repair.reports_and_repairs(turns, stretch)
        assert repaired.agg({"place": "max"}).first()[0] < 4 * stretch
        return sorted(map(tuple, reports.collect())), sorted(map(tuple, repair.digests(repaired).collect()))

    parts, whole = found(16), found(10_000)
    assert parts == whole
    tops = {repair.START: repair.entry(repair.START)}
    seen = set()
    for _, _, role, text in rows[3000:3007]:
        fault = "blank" if text == " " else "duplicate" if (role, text) in seen else "" if text[-1] == "." else "truncated"
        seen.add((role, text))
        tops = repair.read(tops, role[0], fault, 1)
    ends = [e for e in map(repair._ended, tops.values()) if e]
    assert min(e.rank() for e in ends) == next((r[6], r[7]) for r in whole[0] if r[0] == 2)


def test_equal_rows_are_folded_and_long_texts_pass(spark):
    rows = [(1, 1, "user", "Hello.")] * 5000 + [(1, 2, "assistant", "w" * 1_000_000 + ".")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folded = repair.faults(turns).collect()
    assert sorted((r.copies, r.fault) for r in folded) == [(1, ""), (5000, "")]
    reports, repaired = repair.reports_and_repairs(turns)
    report = reports.first()
    assert (report.duplicate, report.cost, report.illegal) == (4999, 4 * 4999, 4999)
    assert report.audit == "K" + "D" * 4999 + "K"
    kept = [(r.role, len(r.text)) for r in repaired.orderBy("stretch", "place").collect() if r.role]
    assert kept == [("user", 6), ("assistant", 1_000_001)]
