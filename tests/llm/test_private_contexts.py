"""op8: contexts of seeds and of candidates."""

from pyspark.sql import functions as F

from wavelath.llm import private


def learned(make, docs):
    texts = dict(docs)
    out = {}
    for r in private.scan(make(*docs)).collect():
        places = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("learned:")]
        assert r["n_learned"] == len(places)
        if places:
            out[r["doc_id"]] = [texts[r["doc_id"]][a:b] for a, b in places]
    return out


def phones(count, lead="call me at"):
    return [(k, f"Please {lead} +1 ({600 + k}) 555-{6000 + 7 * k} today") for k in range(count)]


def test_seeds_with_blanks_teach(make):
    docs = phones(8) + [(100, "Please call me at (663) 555-6869 today"), (101, "Please call me at 663 555 6869."), (102, "the part has number 663 555 6869"), (103, "call me at noon")]
    assert learned(make, docs) == {100: ["(663) 555-6869"], 101: ["663 555 6869"]}


def test_cards_teach(make):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "6011 0000 0000 0004", "4242 4242 4242 4242"]
    docs = [(k, f"paid with card {c} on monday") for k, c in enumerate(cards)]
    docs += [(100, "paid with card 4111 1111 1111 1112 on monday")]  # a wrong check digit
    seeds = sum(r["n_card"] for r in private.scan(make(*docs)).collect())
    assert seeds == 4
    assert learned(make, docs) == {100: ["4111 1111 1111 1112"]}


def test_a_candidate_behind_another_keeps_its_words(make):
    docs = [(k, f"ids ab12cd{k} or mail user{k}@mail.example.com now") for k in range(8)]
    docs += [(100, "x77y88z99 or mail user77(at)mail77 now"), (101, "nothing ab12cd77 user77(at)mail77")]
    assert learned(make, docs) == {100: ["user77(at)mail77"]}


def test_long_words_are_whole(make):
    one, other = "a" + "x" * 200, "b" + "x" * 200
    docs = [(k, f"{one} user{k}@mail.example.com") for k in range(8)] + [(100, f"{one} user77(at)mail77"), (101, f"{other} user78(at)mail78")]
    assert learned(make, docs) == {100: ["user77(at)mail77"]}


def test_contexts_end_at_line_breaks(spark):
    text = "write to\na1b2c3d4 and then\n\nto me x9y8z7w6 at q1w2e3r4, z 5 6 7 8 9 0"
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(private.spans(F.col("text"), private.CANDIDATE)).alias("s")).select("s.*").collect()
    assert [(r["value"], r["pattern"]) for r in rows] == [("a1b2c3d4", ""), ("x9y8z7w6", "to me"), ("q1w2e3r4", "x9y8z7w6 at"), ("5 6 7 8 9 0", "q1w2e3r4, z")]
    assert all(text[r["start"] : r["end"]] == r["value"] for r in rows)


def test_long_runs_are_searched_in_time(make):
    docs = [(1, "1 " * 30000 + "x"), (2, "x" * 300000 + " a@b.c"), (3, "(1" * 50000), (4, "a b\n" * 20000 + "12345678"), (5, "1.-" * 60000 + "é"), (6, "x" * 200000 + "\n" + "y" * 200000 + " 12345678")]
    assert private.scan(make(*docs)).count() == 6


def test_long_texts_take_time_in_proportion(make):
    """A text of 2 MB with 50,000 addresses and as many candidates."""
    import time

    line = "write to user{k}@mail{k}.example.org or see AB{k}XY77 at the desk\n"
    long = "".join(line.replace("{k}", str(k)) for k in range(50_000))
    began = time.perf_counter()
    [row] = private.scan(make((1, long))).collect()
    assert row["n_email"] == 50_000 and time.perf_counter() - began < 90


def test_candidates_that_a_seed_overlaps_are_none(make):
    """Seeds within candidates, around them, and at their edges; against a look at every pair."""
    text = "mail a.b@c.org and x@y.org-5512345 call +1 (663) 555-6869 id 4111 1111 1111 1111 then 555-123-4567 and 10.0.0.1x or 10.0.0.1 end"
    rows = private.surveyed(make((1, text)))
    [r] = rows.collect()
    seeds = [(x["start"], x["end"]) for k in private.KINDS for x in r[k]]
    free = {(c["start"], c["end"]) for c in r["candidates"] if not any(a < c["end"] and c["start"] < b for a, b in seeds)}
    assert seeds and free and len(free) < len(r["candidates"])
    # a pattern that vouches for everything reports all that is free
    found = private.learned(rows, private.Bootstrap(seeds=0, confidence=0.0, score=0.0))
    assert {(x["start"], x["end"]) for x in found.collect()} <= free
