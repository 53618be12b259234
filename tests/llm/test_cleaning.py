"""op3, op7, op10 and the pipeline."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavelath.llm import decontam, linededup, quality

from .conftest import table_of
from .test_neardup import brute

# --- line dedup


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute_lines(rows):
    """The texts without equal and nearly equal lines, the earliest kept; rows: (doc_id, text), ids known and different."""
    places = sorted((k, n, tuple(line.split())) for k, t in rows if t is not None for n, line in enumerate(t.split("\n")))
    first, gone = {}, set()
    for k, n, words in places:
        if len(words) < 5:
            continue
        if words in first:
            gone.add((k, n))
            continue
        if any(one_edit(w, words) for w in first):
            gone.add((k, n))
        first[words] = (k, n)
    return sorted(((k, None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (k, n) not in gone)) for k, t in rows), key=repr)


LINES = [
    (3, "one two three four five six seven eight nine ten eleven\nshort line\nshort line"),
    (1, "one two three four five six seven eight nine ten\nfresh words stand in this place alone"),
    (2, "zero one two three four five six seven eight nine ten\n\nfresh  words stand in\tthis place alone"),
    (4, "one two three four CHANGED six seven eight nine ten\none two CHANGED four five six CHANGED eight nine ten"),
    (5, "a a a a a a a a a a\na a a a a a a a a a a\na a a a a a a a a a a a"), (6, None), (7, ""),
]


def test_lines_against_brute_force(make):
    found = linededup.clean(make(*LINES))
    assert table_of(found, "doc_id", "text") == brute_lines(LINES)
    assert {r["doc_id"]: r["n_dropped"] for r in found.collect()}[3] == 1


def test_lines_of_the_table(documents, rows):
    assert table_of(linededup.clean(documents), "doc_id", "text") == brute_lines(rows)


def test_lines_odd_rows(odd):
    found = linededup.clean(odd.withColumn("first", F.lit("clash")))
    assert found.columns == [*odd.columns, "first", "n_lines", "n_dropped"]
    assert found.count() == odd.count()
    assert linededup.clean(odd.limit(0)).collect() == []


HEADED = "Chapter one\nthese words stand below a heading of two words\n\nand so do these, which end the text"


def test_a_copy_with_a_short_line_goes_as_a_whole(spark, sf_dir, make):
    docs = make((1, HEADED), (2, HEADED), (3, "Chapter one\nanother text of which no line stands elsewhere at all"), (4, "Chapter two\n" + HEADED), (5, "no lines\nno lines"), (6, None), (7, " \n"), (8, "no lines"))
    assert {r["doc_id"] for r in linededup.marked(docs).collect() if r["is_copy"]} == {2, 8}
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).collect()}
    assert found == {1: HEADED, 3: "Chapter one\nanother text of which no line stands elsewhere at all", 4: "Chapter two\nChapter one\n", 5: "no lines\nno lines", 6: None, 7: " \n"}


YES = ["Yes it is", "No it is not", "Maybe later"]


def test_short_lines_of_several_rows_make_no_copy(make):
    """Each line of row 4 stands in an earlier row, all of them in none: it says something of its own. Row 5 repeats row 4, row 6 a part of it."""
    own = [(k, f"{line}\nand behind it row number {k} has {'many ' * k}words of its own") for k, line in enumerate(YES, 1)]
    docs = make(*own, (4, "\n".join(YES)), (5, "\n".join(reversed(YES))), (6, YES[0]), (7, f"{YES[1]}\n{YES[2]}"))
    assert {r["doc_id"] for r in linededup.marked(docs).collect() if r["is_copy"]} == {5, 6}


def whole_copies(rows):
    """Ids of the documents of which each longer line is dropped, and whose short lines stand together in an earlier document."""
    left = {k: (t or "").split("\n") for k, t in brute_lines(rows)}
    first, sets, out = {}, {}, set()
    for k, t in sorted(r for r in rows if r[1] is not None):
        lines = [tuple(line.split()) for line in t.split("\n")]
        short = frozenset(w for w in lines if 0 < len(w) < 5)
        for w in short:
            first.setdefault(w, k)
        rest = [tuple(line.split()) for line in left[k] if line.split()]
        met = {first[w] for w in short}
        if any(lines) and all(len(w) < 5 for w in rest) and (not short or short in sets or len(met) == 1 and met != {k}):
            out.add(k)
        sets.setdefault(short, k)
    return out


def test_copies_of_the_table_go_as_a_whole(spark, sf_dir, documents, rows):
    copies = whole_copies(rows)
    assert len(copies) > 5
    assert table_of(corpus_pipeline.drop_repeated_lines(spark, documents, sf_dir), "doc_id", "text") == [x for x in brute_lines(rows) if x[0] not in copies]
    assert {r["doc_id"] for r in linededup.op7_deletion_neighbours(spark, sf_dir).collect() if r["is_copy"]} == copies


# --- decontamination

ITEM = "The train from Berlin leaves at 7 o'clock and covers 300 km while Alice waits at the old station for 45 minutes before she goes home"


def test_templates(spark, make):
    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (3, "short item of six plain words"), (4, "")], "item_id long, text string")
    docs = make(
        (1, "Some text ahead. " + ITEM + " And text behind."),
        (2, ITEM.replace("Berlin", "Madrid").replace("7", "9").replace("300", "512").replace("Alice", "Robert")),
        (3, "The train from Berlin is late. Nobody waits at the old station."),
        (4, "we saw a short item of six plain words there"), (5, None), (6, ""), (None, ITEM), (7, ITEM.upper()),
    )
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.matches(docs, benchmark).collect()}
    assert set(found) >= {(1, 1), (2, 1), (4, 3), (None, 1)} and not {k for k, _ in found} & {3, 5, 6}
    assert found[1, 1]["changed"] == 0 and found[2, 1]["changed"] == 4 and found[1, 1]["coverage"] == 1
    kept = decontam.uncontaminated(docs.withColumn("_x", F.lit(1)), benchmark)
    assert kept.columns == [*docs.columns, "_x"]
    assert {r["doc_id"] for r in kept.collect()} >= {3, 5, 6} and not {r["doc_id"] for r in kept.collect()} & {1, 2, 4, None}


DENSE = {
    1: "A train in London travels 60 miles in 2 hours. In 5 hours a car in Paris travels 90 miles.",
    2: "Convert 3 miles 5 yards 2 feet in inches",
    3: "Is 7 prime?",
    4: "Add 3 km 5 cm 7 mm 2 miles 9 yards to what Alice and Robert have walked so far",
}


def test_items_dense_in_numbers_and_units(spark, make):
    benchmark = spark.createDataFrame([*DENSE.items(), (9, "5"), (10, "7 8")], "item_id long, text string")
    docs = make(
        *[(k, f"Some words ahead. {t} And some behind.") for k, t in DENSE.items()], (11, DENSE[1].replace("60", "75").replace("London", "Madrid").replace("90", "30")), (13, "Is 9 prime?"),
        (14, DENSE[4].replace("3", "8").replace("9", "6").replace("Alice", "Carol")), (15, "5 or 7 8"),
    )
    found = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontam.matches(docs, benchmark).collect()}
    assert found == {(1, 1): 0, (2, 2): 0, (3, 3): 0, (4, 4): 0, (11, 1): 3, (14, 4): 3}


def test_letters_are_units_behind_numbers_only():
    kinds = lambda text: decontam.canonical([text], decontam.Canon())[1].tolist()
    assert kinds("we met a man in 5 m of rope and 5 in of wire") == [0, 0, 0, 0, 0, 1, 2, 0, 0, 0, 1, 2, 0, 0]
    assert kinds("it covers 7. A train") == [0, 0, 1, 0, 0]


def test_slots_must_agree(spark, make):
    item = "we know that 5 apples and 5 pears cost as much as 9 plums do so that 5 is the answer here"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make((1, item.replace("5", "8").replace("9", "3")), (2, "we know that 8 apples and 6 pears cost as much as 3 plums do so that 7 is the answer here"))
    assert table_of(decontam.matches(docs, benchmark), "doc_id", "changed") == [(1, 4)]


def test_benchmark_passages_of_the_table(spark, sf_dir, rows):
    """Items that stand word for word in a text are found; the others are not far from one."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    planted = {(k, i) for k, t in rows for i, item in items if item and " ".join(item.split()) in " ".join((t or "").split())}
    found = {(r["doc_id"], r["item_id"]) for r in decontam.op3_template_windows(spark, sf_dir).collect()}
    assert planted <= found


def test_decontamination_of_nothing(spark, make, odd):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(odd, nothing).collect() == []
    assert decontam.uncontaminated(odd, nothing).count() == odd.count()
    assert decontam.matches(odd.limit(0), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect() == []


# --- quality


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 4 == 2


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in quality.op10_random_indexing(spark, sf_dir).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert all(r["held_out"] == held(k) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for k, r in found.items())
    own = [(found[k]["predicted"], y) for k, y in labels if held(k) and k in found]
    assert len(own) > 50
    assert sum(p == y for p, y in own) / len(own) > 0.85


def test_held_out_labels_change_nothing(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [table_of(quality.score(documents, *quality.fit(documents, y)), "doc_id", "score") for y in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (99, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for y in (labels, labels.limit(0), labels.filter("quality = 1")):
        found = quality.score(odd, *quality.fit(odd, y)).collect()
        assert len(found) == 10 and all(0 <= r["score"] <= 1 for r in found)
    vectors, net = quality.fit(odd.limit(0), labels)
    assert quality.score(odd.limit(0), vectors, net).collect() == []


# --- the pipeline


def test_pipeline_against_brute_force(spark, sf_dir, rows):
    got = corpus_pipeline.run(spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.score(documents, *quality.fit(documents, labels)).collect()}
    good = [(k, t) for k, t in rows if scores[k] >= 0.7]
    copies = whole_copies(good)
    lines = [(k, t) for k, t in brute_lines(good) if k not in copies]
    alone = {k for k, _, _, kept in brute(lines, 5) if kept}
    kept = [(k, t) for k, t in lines if k in alone]
    leaks = {r["doc_id"] for r in decontam.matches(spark.createDataFrame(kept, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert table_of(got, "doc_id", "text") == sorted(((k, t) for k, t in kept if k not in leaks), key=repr)
    first = got.first()
    assert first["n_chars"] == len(first["text"]) and len(first["ids"]) == len(first["begins"]) == len(first["ends"])


def test_stages_return_documents(spark, sf_dir, documents):
    docs = documents.limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == documents.columns, name


@pytest.mark.parametrize("stage", range(5))
def test_stages_bear_clashing_names(spark, sf_dir, odd, stage):
    """Columns with the names that the operators use themselves come back as they were."""
    names = ["row", "doc", "mark", "gone", "line", "words", "node", "name", "score", "predicted", "n_lines", "n_dropped", "_node", "first", "key"]
    docs = odd.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    found = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
    assert found.columns[: len(docs.columns)] == docs.columns
    rows = found.collect()
    assert stage == 0 or rows
    assert all(r[n] == f"{n}{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)


@pytest.mark.parametrize("stage", range(5))
def test_stages_bear_odd_rows(spark, sf_dir, odd, stage):
    name, run = corpus_pipeline.STAGES[stage]
    run(spark, odd, sf_dir).collect()
    assert run(spark, odd.limit(0), sf_dir).collect() == []


