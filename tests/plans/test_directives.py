import random

from fieldlamp.operators import directives as D


def walked(text, flags, phones_text="find help in person ({n})"):
    """The text, or (place, problem) of the first error, by recursion."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{#(if|unless)\s+([\w:-]+)\s*\}\}|(\{\{else\}\})|\{\{/(if|unless)\}\}", text or ""):
        parts += [("text", at, text[at : m.start()]), (m, m.start(), None)]
        at = m.end()
    parts.append(("text", at, (text or "")[at:]))
    i = 0

    def run(block):
        nonlocal i
        out = {"then": "", "else": ""}
        side = "then"
        while i < len(parts):
            what, at, s = parts[i]
            i += 1
            if what == "text":
                out[side] += s
            elif what[1]:
                inner = run((what[1], what[2], at))
                value = flags.get(what[2], False if what[2].startswith("scenario:") else None)
                out[side] += inner["else" if bool(value) == (what[1] == "unless") else "then"]
            elif what[3]:
                side = "else"
            else:
                return out
        return out

    s = run(None)["then"]
    return re.sub(r"\[\[call ([^\]]+)\]\]", lambda m: f"call {m[1]}" if flags.get("phones", True) else phones_text.format(n=m[1]), s)


def nested(rnd, depth):
    s = rnd.choice(["", "text ", "[[call 999]] ", "a\nb", "{{odd}} "])
    if depth and rnd.random() < 0.8:
        kind, name = rnd.choice(["if", "unless"]), rnd.choice(["power", "water", "phones", "scenario:flood"])
        s += "{{#%s %s}}" % (kind, name) + nested(rnd, depth - 1) + ("{{else}}" + nested(rnd, depth - 1) if rnd.random() < 0.6 else "") + "{{/%s}}" % kind
    return s + (nested(rnd, depth - 1) if depth and rnd.random() < 0.5 else "")


def test_directives_equal_a_recursive_version(spark):
    rnd = random.Random(8)
    docs = [(i, nested(rnd, rnd.randint(0, 5))) for i in range(150)] + [(900, None), (901, "")]
    flags = {i: {f: rnd.random() < 0.5 for f in ("power", "water", "phones") + (("scenario:flood",) if i % 2 else ())} for i, _ in docs}
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, depth int")
    fl = spark.createDataFrame([(i, f, v) for i, own in flags.items() for f, v in own.items()], "doc_id long, flag string, value boolean")
    got = {r.doc_id: r.text for r in D.resolved(df, fl).collect()}
    assert got == {i: walked(t, flags[i]) for i, t in docs}
    assert D.problems(df, known=fl).count() == 0
    sets = {}
    for r in D.branches(df.filter("doc_id < 60")).collect():
        sets.setdefault(r.doc_id, []).append((dict(r.flags), r.text))
    for i, t in docs[:60]:
        names = sorted({f for f in flags[1] if f"{{{{#if {f}}}}}" in t or f"{{{{#unless {f}}}}}" in t} | ({"phones"} if "[[call" in t else set()))
        assert len(sets[i]) == 2 ** len(names) and len({tuple(sorted(f.items())) for f, _ in sets[i]}) == len(sets[i])
        assert all(s == walked(t, f) and sorted(f) == names for f, s in sets[i])


def test_errors_and_where_they_are(spark):
    rows = {
        1: ("ab{{else}}", (2, "without a block")), 2: ("{{/if}}", (0, "without a block")), 3: ("é{{#if a}}", (1, "never closed")), 4: ("{{#if a}}{{else}}{{else}}{{/if}}", (17, "second else")),
        5: ("x {{#if a}} y {{/unless}}", (14, "closed by the other kind")), 6: ("{{#if zz}}{{/if}}", (0, "unknown flag")), 7: ("{{#if scenario:q}}x{{/if}}", None), 8: (None, None),
        9: ("{{#if a}}{{#unless a}}{{/unless}}", (0, "never closed")), 10: ("{{#if a}}{{/if}}{{/if}}{{#if a}}", (16, "without a block")),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")
    known = spark.createDataFrame([(i, "a", True) for i in rows], "doc_id long, flag string, value boolean")
    got = {r.doc_id: (r.at, r.problem) for r in D.problems(df, known=known).collect()}
    assert got == {i: p for i, (_, p) in rows.items() if p}
    assert {r.doc_id: r.text for r in D.resolved(df, known).collect()} == {7: "", 8: ""}
    many = spark.createDataFrame([(1, "".join("{{#if f%d}}x{{/if}}" % i for i in range(7)))], "doc_id long, text string")
    assert D.flag_sets(many).count() == 0


def test_tokens_are_looked_at_once_for_all_branches(spark):
    deep = "{{#if a}}" * 40 + "x" + "{{/if}}" * 40 + "{{#unless a}}y{{else}}z{{#if b}}[[call 7]]{{/if}}{{/unless}}"
    texts = {1: deep, 2: "no marks", 3: None, 4: "{{#if a}}", 5: "{{/if}} {{#if b}}x{{/if}}", 6: "".join("{{#if f%d}}%d{{else}}-{{/if}}" % (i, i) for i in range(6)), 7: "".join("{{#if f%d}}x{{/if}}" % i for i in range(7))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    shown = D.branches(docs)
    got = {}
    for r in shown.collect():
        got.setdefault(r.doc_id, []).append((r.set, dict(r.flags), r.text))
    assert {i: len(x) for i, x in got.items()} == {1: 8, 2: 1, 3: 1, 6: 64}
    for i, rows in got.items():
        assert sorted(s for s, _, _ in rows) == list(range(len(rows)))
        assert all(t == walked(texts[i], f) for _, f, t in rows)
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan
