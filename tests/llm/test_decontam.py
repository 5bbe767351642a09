import pytest

from diagtab.llm import decontam as D

ITEM = "Tom buys 5 apples and 3 pears at the market, then he gives 5 apples to Ann who lives 12 km away. How many apples does Tom keep?"


@pytest.fixture(scope="module")
def found(spark):
    filler = "here are some words that say nothing about fruit at all and go on for a while"
    other = ITEM.replace("Tom", "Ben").replace("Ann", "Eva").replace("5", "17").replace("3", "20").replace("12", "1,500").replace("km", "miles")
    texts = {
        0: f"{filler} {ITEM} {filler}",
        1: f"{filler}\n{other}\n{filler}",
        2: f"{filler} {ITEM.replace('keep', 'have')} {filler}",  # one plain word differs
        3: f"{filler} {ITEM.replace('5 apples and 3', '5 apples and 5').replace('Ann', 'Tom').replace('gives 5', 'gives 8').replace('does Tom', 'does Jim')}",
        4: filler,
        5: None,
        6: "",
        7: ITEM[:60],
        8: f"{ITEM} {filler} {other}",  # twice, filled in differently
        9: " ".join([filler] * 3000 + [other]),
        10: ITEM.replace("then he", "and then after that he"),  # words put in between
        None: ITEM,
    }
    rows = [(k, v, 1, 2, "x") for k, v in texts.items()] + [(0, texts[0], 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long, at int, w string")
    items = spark.createDataFrame([(7, ITEM, 0), (8, "Too short", 0), (9, None, 0), (7, ITEM, 1), (None, ITEM, 0),
                                   (11, "ONE TWO THREE FOUR FIVE SIX", 0)], "item_id long, text string, key long")
    return docs, items


def test_exact_changed_and_filled_in_anew(found):
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(*found).collect()}
    assert set(got) == {(i, 7) for i in (0, 1, 2, 8, 9, 10)}
    n = len(ITEM.split())
    assert all(r.n_words == n for r in got.values())
    assert {i: got[i, 7].n_found for i in (0, 1, 8, 9)} == dict.fromkeys((0, 1, 8, 9), n)
    assert got[2, 7].n_found == n - 1 and 0.8 <= got[10, 7].coverage


def test_shuffled_and_broadcast_windows_agree(found, monkeypatch):
    want = sorted(map(tuple, D.contaminated(*found).collect()))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, D.contaminated(*found).collect())) == want


def test_empty(found, no_docs):
    docs, items = found
    assert D.contaminated(no_docs, items).collect() == []
    assert D.contaminated(docs, items.limit(0)).collect() == []


def test_no_python_in_the_plan(found):
    plan = D.contaminated(*found)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


LISTS = {
    1: "Find the median of the following data set: 12, 15, 11, 20, 19, 14, 13, 18, 17, 16, 21, 22, 25",
    2: "Ana Ruiz, Ben Ott, Carl Moss, Dora Lee, Eva Kern, Finn Hale and Gus Ward sit in a row",
}


def copies_found(spark, texts, items):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    listed = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_found, r.n_words) for r in D.contaminated(docs, listed).collect()}


@pytest.mark.parametrize("most", [0, D.BROADCAST_WINDOWS])
def test_runs_of_numbers_and_names_count(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", most)
    texts = LISTS | {3: f"first some words. {LISTS[1]}; {LISTS[2]} and more", 4: LISTS[1][:60]}
    assert copies_found(spark, texts, LISTS) == {(1, 1): (21, 21), (2, 2): (19, 19), (3, 1): (21, 21), (3, 2): (19, 19)}


@pytest.mark.parametrize("most", [0, D.BROADCAST_WINDOWS])
def test_copies_in_another_case(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", most)
    items = LISTS | {3: ITEM, 4: "Élan vital means what to Henri Bergson in the year 1907"}
    texts = {10 * i + k: f"Some words. {change(x)} And more." for i, x in items.items() for k, change in enumerate((str.lower, str.upper, str.title))}
    got = copies_found(spark, texts, items)
    assert set(got) == {(doc, doc // 10) for doc in texts}
    assert all(found == n for found, n in got.values())


def test_short_items_as_a_whole(spark):
    items = {1: "What is 17 * 23?", 2: "Two words", 3: "Name three rivers", 4: ITEM}
    texts = {1: "He asked: what IS 17, 23 now", 2: "What is 17 times 23", 3: "two words", 4: "first NAME three, rivers", 5: f"{ITEM} What is 17 * 23?", 6: "is"}
    n = len(ITEM.split())
    assert copies_found(spark, texts, items) == {(1, 1): (4, 4), (4, 3): (3, 3), (5, 4): (n, n), (5, 1): (4, 4)}


def test_an_item_many_times_in_one_text(spark):
    """What is kept per text and item does not grow with the times it stands there."""
    texts = {1: " and ".join([LISTS[1]] * 500), 2: " and ".join(LISTS[1].replace("12", str(k)) for k in range(100, 400))}
    got = copies_found(spark, texts, LISTS)
    assert got == {(1, 1): (21, 21), (2, 1): (21, 21)}
