import re
from collections import Counter

from ridertide.llm import cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places), len(lines))
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    gaps = " \t\n\x0b\x0c\r"
    letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in words)
    bullets = sum(x.strip(gaps).startswith(("-", "*", "•")) for x in lines)
    ellipses = sum(x.strip(gaps).endswith(("...", "…")) for x in lines)
    good = (
        5 * counts[0] <= 2 * counts[1] <= 24 * counts[0]
        and 10 * counts[2] <= counts[0]
        and 2 * counts[3] <= counts[5]
        and 100 * letters >= 80 * counts[0]
        and 100 * bullets <= 90 * counts[5]
        and 100 * ellipses <= 30 * counts[5]
    )
    return (*counts, failed, not failed and good)


def extra(spark, odd):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu ".split()
    long = " ".join(f"{w}{i}" for i in range(6) for w in word)
    texts = [
        "\n".join("-" + x for x in long.split(" ")),
        "\n".join(x + "..." for x in long.split(" ")) + "\n…",
        "\n".join(["same line"] * 3) + "\n" + long,
        " ".join(f"#{i}" for i in range(80)),
        " ".join(str(i * i) for i in range(90)),
        long.replace(" ", "\r\n"),
        "a b " + " ".join(chr(97 + i % 26) + str(i % 9) for i in range(80)),
    ]
    rows = [(1000 + i, t, None, None, None, None, None, None) for i, t in enumerate(texts)]
    return odd.unionByName(spark.createDataFrame(rows, odd.schema))


def test_same_as_brute_force(spark, odd):
    docs = extra(spark, odd)
    want = sorted((str(r["doc_id"]), *brute(r["text"])) for r in docs.collect())
    got = sorted((str(r[0]), *r[1:9]) for r in cascade.judged(docs).collect())
    assert got == want
    assert {w[-1] for w in want if not w[-2]} == {True, False}


def test_order_changes_no_verdict(spark, odd):
    docs = extra(spark, odd)
    names = list(cascade.RULES)
    one = sorted((str(r["doc_id"]), r["kept"], r["n_words"]) for r in cascade.judged(docs, names).collect())
    two = sorted((str(r["doc_id"]), r["kept"], r["n_words"]) for r in cascade.judged(docs, names[::-1]).collect())
    assert one == two
    rejected = {r["rejected_by"] for r in cascade.judged(docs, names).collect()}
    assert {"base", "few_symbols", "few_bullets", "few_ellipses", "with_letters", None} <= rejected


def test_rules_are_ordered_by_rejection_per_cost(spark, odd):
    order = cascade.rule_order(extra(spark, odd))
    assert sorted(n for n, _ in order) == sorted(cascade.RULES)
    rates = [r for _, r in order]
    assert rates == sorted(rates, reverse=True) and rates[0] > 0


def test_empty(empty):
    assert cascade.judged(empty).count() == 0
