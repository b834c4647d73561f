import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestone.llm import conversations as C

SPACE = "[^\x20\x09-\x0d]"
NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def brute_repair(rows):
    """The least (cost, audit, repaired rows) among all edits of rows (role, text, fault)."""
    found = [(0, "", ())]
    limit = 4 * len(rows) + 7

    def inserted(cost, audit, out):
        for n in range(4):
            for roles in itertools.product(("user", "assistant"), repeat=n):
                yield cost + 3 * n, audit + "I" * n, (*out, *((r, "") for r in roles))

    def prefix(out):
        return re.fullmatch(r"s?(ua)*u?", "".join(r[:1] or "?" for r, _ in out)) is not None

    for role, text, fault in rows:
        after = []
        for state in found:
            for cost, audit, out in inserted(*state):
                after.append((cost + 4, audit + "D", out))
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    after.append((cost + more, audit + "K", (*out, (role, text))))
                    for new in ("user", "assistant"):
                        after.append((cost + more + 3, audit + "R", (*out, (new, text))))
        best = {}
        for s in after:
            if s[0] <= limit and prefix(s[2]):
                key = "".join(r[:1] for r, _ in s[2])[-1:] or "-"
                # only what ends alike and costs the same can still win
                best.setdefault(key, []).append(s)
        found = []
        for some in best.values():
            least = min(s[0] for s in some)
            ties = [s for s in some if s[0] == least]
            found.append(min(ties, key=lambda s: s[1]))
    whole = [s for state in found for s in inserted(*state) if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in s[2]))]
    return min(whole, key=lambda s: s[:2])


def brute(table):
    out = []
    for conv in dict.fromkeys(r[0] for r in table):
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            rows += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            last = re.findall(SPACE, text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                count[fault] += 1
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, fixed = brute_repair(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *count.values(), illegal, cost, audit, sha))
    return sorted(out, key=str)


def table(seed, convs=120, most=7):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "And then", "é ü?", " \n", "", "Well. ", "ok\x0b", None, "a:b\nc."]
    rows = []
    for c in range(convs):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(0, most // 2)
        for t, role in enumerate(roles):
            if rng.random() < 0.3:
                role = rng.choice(["user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randint(0, 99)}."
            rows.append((c if c else None, None if rng.random() < 0.05 else t + (rng.random() < 0.1), role, text))
    rng.shuffle(rows)
    return rows


def reported(spark, rows, **more):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")
    out = C.reports(spark, d, **more)
    assert out.columns == [c.split()[0] for c in C.REPORT.split(", ")]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("most_bytes", [None, 1, 500])
def test_matches_brute_force(spark, monkeypatch, most_bytes):
    """With small bounds all, or some, conversations are cut into stretches."""
    monkeypatch.setattr(C, "STRETCH", 3)
    rows = table(7)
    rows += [(500, t, "user", "Again.") for t in range(6)] + [(501, 1, "user", "One.")] * 4 + [(502, None, None, None)]
    rows += [(503, t, "user", "x") for t in range(40) if zlib.crc32(f"503:{t}".encode()) % 20 == 0]  # all rows go
    assert reported(spark, rows, most_bytes=most_bytes) == brute(rows)
    assert (503, *NONE[:5], 0, "", NONE[-1]) in brute(rows)


def test_stretches_join_to_the_same(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        rows = [(rng.choice("suaaut"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 14))]
        whole = C.parse(rows)
        for size in (1, 4):
            if rows:
                assert C.finish(C.join([C.stretch(rows[i : i + size]) for i in range(0, len(rows), size)])) == whole
        cost, audit, _ = brute_repair([({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[i], "x", [None, "blank", "duplicate", "truncated"][f]) for i, f in rows])
        assert (cost, audit) == whole


def test_a_long_conversation_and_repaired_rows(spark, monkeypatch):
    rows = [(9, t, "user" if t % 2 == 0 or t % 50 == 1 else "assistant", f"Text {t}." if t % 31 else "Same.") for t in range(3000)]
    rows += [(9, 7, "user", "Again and again.")] * 500 + [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (2, 0, "assistant", "Yes.")]
    small, large = reported(spark, rows), reported(spark, rows, most_bytes=1000)
    assert small == large
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = ({(r.conv_id, r.turn): (r.role, r.text) for r in C.repair(spark, d, want_rows=True, most_bytes=m).collect()} for m in (None, 1000))
    assert a == b
    assert [a[1, i] for i in range(2)] == [("user", "Hi."), ("assistant", "There.")] and (1, 2) not in a
    assert [a[2, i] for i in range(2)] == [("user", ""), ("assistant", "Yes.")]
    roles = [a[9, i][0][0] for i in range(sum(k[0] == 9 for k in a))]
    assert re.fullmatch("(ua)+", "".join(roles))


def test_empty_table(spark):
    assert reported(spark, []) == []
