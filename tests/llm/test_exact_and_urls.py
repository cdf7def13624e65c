import hashlib
import re

from llm.fixtures import awkward_texts, clashing, documents

from tamarack.llm.exact_dedup import exact_dedup
from tamarack.llm.url_filters import RULES, judge_urls

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute_force(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], keep, len(members), digest, -m[0]) for m in members]
    return sorted(out, key=repr)


def decided(df):
    return df.select("doc_id", "keep_id", "group_size", "text_sha256", "n_chars").collect()


def test_equals_brute_force_for_frequent_and_rare_digests(spark):
    rows = awkward_texts()
    for support in (0.5, 0.02, 1e-4):
        found = exact_dedup(documents(spark, rows), support=support)
        assert sorted(map(tuple, decided(found)), key=repr) == brute_force(rows)
        kept = found.where("kept").groupBy("text_sha256").count().collect()
        assert {r["count"] for r in kept} == {1} and len(kept) == found.select("text_sha256").distinct().count()


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    rows.append((5000, "hot text     "))
    found = exact_dedup(documents(spark, rows))
    assert sorted(map(tuple, decided(found)), key=repr) == brute_force(rows)
    assert [r.doc_id for r in found.where("kept AND group_size > 1").collect()] == [5000]


def test_empty_and_clashing(spark):
    assert exact_dedup(documents(spark, [])).count() == 0
    rows = awkward_texts()
    assert sorted(map(tuple, decided(exact_dedup(clashing(documents(spark, rows))))), key=repr) == brute_force(rows)


def judged(spark, urls, rules=RULES, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.sql(rules) if isinstance(rules, str) else spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: tuple(r)[1:] for r in judge_urls(pages, rules, **options).collect()}


def test_rules_by_hand(spark):
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1?q#f", "https://a.b.example.org/en/12",
        "https://a.example.org/en/2", "x://notexample.org/es/", "y://com/fr/", "y://fr.com/de/x#y", "z://com", "z://org?/",
        "http://a..org/", "http://u@h.com:80/fr/",
    ]
    assert judged(spark, urls) == {
        0: ("", "", None, "allow"),
        1: ("", "", None, "allow"),
        2: ("", "", None, "allow"),
        3: ("", "", None, "allow"),
        4: ("example.org", "/es/1", "example.org/es/", "block"),
        5: ("a.b.example.org", "/en/12", "example.org/en/1", "block"),
        6: ("a.example.org", "/en/2", "org/", "allow"),
        7: ("notexample.org", "/es/", "org/", "allow"),
        8: ("com", "/fr/", "com/fr/", "allow"),
        9: ("fr.com", "/de/x", "com/de/", "block"),
        10: ("com", "", None, "allow"),
        11: ("org", "", None, "allow"),
        12: ("a..org", "/", "org/", "allow"),
        13: ("u@h.com:80", "/fr/", None, "allow"),
    }


def test_ties_nulls_and_no_rules(spark):
    rules = [("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("b", "/xyz", "allow"), (None, "/", "block"), ("", "/", "block"),
             ("a.b", "/x", "block")]
    assert judged(spark, ["h://a.b/xyz"], rules)[0][2:] == ("a.b/x", "block")  # as long, but the host is longer
    assert judged(spark, ["h://a.b/xyz", "h://a.b/xyz", None], [], default="block") == {
        0: ("a.b", "/xyz", None, "block"), 1: ("a.b", "/xyz", None, "block"), 2: ("", "", None, "block"),
    }
    assert judged(spark, ["h://a.b"], rules)[0] == ("a.b", "", None, "allow")


def test_many_rules_without_a_broadcast(spark):
    rules = [(f"h{i}.net", f"/p{i % 7}", "block") for i in range(500)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = judged(spark, [f"x://w.h{i}.net/p{i % 7}/q" for i in range(600)], rules)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(v[3] == "block" for v in found.values()) == 500
