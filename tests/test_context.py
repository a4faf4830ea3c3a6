"""The context budget and the texts around it."""

import random

from tessera.operators import context


def reference(history, readme, evidence, budget):
    """Everything counted anew after each step."""
    est = lambda s: 0 if not s else int(len(s) / 3.0) + 1
    history, evidence = list(history), list(evidence)
    total = lambda: sum(map(est, history)) + est(readme) + sum(map(est, evidence))
    n = len(history)
    while total() > budget and history:
        history.pop(0)
    if total() > budget and readme:
        keep = max(0, len(readme) - int((total() - budget) * 3.0) - len(context.TRUNCATED))
        readme = readme[:keep].rstrip() + context.TRUNCATED if keep else ""
    for i in range(len(evidence) - 1, -1, -1):
        if total() <= budget:
            break
        keep = max(int(i == 0), len(evidence[i]) - int((total() - budget) * 3.0) - len(context.TRUNCATED))
        if keep < len(evidence[i]):
            evidence[i] = (evidence[i][:keep].rstrip() or evidence[i][:1]) + context.TRUNCATED
    return n - len(history), readme, evidence


def test_budget_against_counting_anew():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab \n") for _ in range(n))
    for _ in range(3000):
        args = [text(rng.randrange(80)) for _ in range(rng.randrange(5))], text(rng.choice([0, 20, 300])), [text(rng.randrange(200)) for _ in range(rng.randrange(4))], rng.randrange(200)
        assert context.fit_context(*args) == reference(*args)


def test_budget_of_rows(spark):
    rows = [(1, ["user: a" * 50, "user: b"], "r" * 900, ["x" * 300, "y" * 300]), (2, None, None, None), (3, [], "", ["z" * 3000])]
    df = spark.createDataFrame(rows, "id long, history array<string>, readme string, evidence array<string>")
    got = {r["id"]: r for r in context.context_budget(df, 120).collect()}
    for i, h, r, e in rows:
        want = reference(h or [], r or "", e or [], 120)
        assert (got[i]["dropped"], got[i]["readme"], got[i]["evidence"]) == want and got[i]["history"] == (h or [])[want[0] :]
    assert len(got[3]["evidence"]) == 1 and got[3]["evidence"][0][0] == "z"


def test_enrichment_and_citations(spark):
    m = spark.createDataFrame([(1, 0, "user", "q0", []), (1, 1, "assistant", "a0", ["s1", "f1"]), (1, 2, "user", "q1", []), (1, 3, "assistant", "a1", ["s2", "s1"]), (1, 4, "user", "q2", []), (1, 5, "user", "q3", [])],
                              "conv_id long, turn long, role string, text string, cited array<string>")
    q = spark.createDataFrame([(1, "now?"), (2, "first?")], "conv_id long, question string")
    got = {r["conv_id"]: r["query"] for r in context.enriched_query(m, q).collect()}
    assert got == {1: "Recent conversation questions: q1 | q2 | q3\nRecently discussed code: s1, f1, s2\nnow?", 2: "first?"}
    assert context.recent_citations(m).collect()[0]["cited"] == ["s2", "s1", "f1"]


def test_texts(spark):
    a = spark.createDataFrame([(1, " yes ", True, True), (2, "", False, False), (3, None, True, False), (4, "x", False, False)], "id long, raw string, insufficient boolean, ambiguous boolean")
    got = {r["id"]: r["text"] for r in context.answer_text(a).collect()}
    assert got[1].split("\n\n")[1] == "yes" and got[1].count("\n\n") == 2 and got[2].startswith("The model did not") and got[3].startswith("The repository") and got[4] == "x"
    c = spark.createDataFrame([(1, "q", ["user: h"], "README", "r", ["e1", "e2"]), (2, "q", [], "", "", [])], "id long, question string, history array<string>, readme_path string, readme string, evidence array<string>")
    got = {r["id"]: r["prompt"] for r in context.prompt_text(c).collect()}
    assert got == {1: "Conversation so far:\nuser: h\n\nProject README (README):\nr\n\nRetrieved evidence:\ne1\n\ne2\n\nq", 2: "q"}
    f = spark.createDataFrame([("readme.txt", "late"), ("README.rst", " " + "w" * 8001), ("README.md", "no")], "path string, text string")
    r = context.read_readme(f).first()
    assert r["path"] == "README.rst" and r["content"] == "w" * 8000 + context.README_TRUNCATED
    assert context.read_readme(f.where("path = 'README.md'")).count() == 0
