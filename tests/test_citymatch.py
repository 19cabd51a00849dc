"""City matching against a slow nested-loop search on small random inputs."""

import random

import pytest

from posterwall.operators import citymatch as cm

NAMES = [
    "Берлин | Berlin", "Барселона | Barcelona", "Бар | Bar", "Новый Рио | Rio Nuevo", "Рио | Rio",
    "Старый Тбилиси | Old Tbilisi", "Токио | Tokyo", "Сан | San", "Лондон", "| Łódź", "Йошкар-Ола | Yoshkar",
]


def _cities(spark, names):
    rows = [(str(i), f"c{i}", n, i, i + 1, ("1.5", "2.5")) for i, n in enumerate(names)]
    return spark.createDataFrame(
        rows, "_id string, country_id string, name string, sort int, city_ord bigint, coordinates struct<lat:string,lon:string>"
    )


def _tokens(name):
    return [t.strip().lower() for t in name.split("|") if t.strip()]


def _touch(a, b):
    return a in b or b in a


def brute_simple(target, names):
    return next((i for i, n in enumerate(names) if any(_touch(t, target) for t in _tokens(n))), None)


def brute_address(target, names):
    parts = [p.strip() for p in target.replace("•", ",").split(",") if p.strip()]

    def first(fits):
        return next((i for i, n in enumerate(names) if any(fits(t) for t in _tokens(n))), None)

    for part in parts[::-1][:3]:
        words = [w for w in part.split() if len(w) > 2]
        tests = []
        for at in range(len(words))[::-1]:
            word = words[at]
            tests.append(lambda t, w=word: w == t or (_touch(t, w) and max(len(w), len(t)) >= 4))
            if at:
                pair = f"{words[at - 1]} {word}"
                tests.append(lambda t, p=pair: _touch(t, p))
        tests.append(lambda t, p=part: _touch(t, p) and max(len(p), len(t)) >= 4)
        for test in tests:
            hit = first(test)
            if hit is not None:
                return hit
    return None


def _random_inputs(seed, n_cities, n_targets):
    rnd = random.Random(seed)
    piece = lambda low, high: "".join(rnd.choice("abc") for _ in range(rnd.randint(low, high)))
    names = [" | ".join(" ".join(piece(1, 5) for _ in range(rnd.randint(1, 2))) for _ in range(rnd.randint(1, 2))) for _ in range(n_cities)]
    words = lambda: " ".join(piece(1, 6) for _ in range(rnd.randint(1, 4)))
    targets = sorted({rnd.choice([", ", " • ", ","]).join(words() for _ in range(rnd.randint(1, 5))) for _ in range(n_targets)})
    return names, targets


def _resolved(spark, names, targets, resolve):
    df = spark.createDataFrame([(t,) for t in targets], "t string")
    rows = resolve(df, _cities(spark, names), "t").select("t", "city._id").collect()
    assert len(rows) == len(targets)
    return {r["t"]: None if r["_id"] is None else int(r["_id"]) for r in rows}


@pytest.mark.parametrize("gram", [3, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_search(spark, monkeypatch, seed, gram):
    monkeypatch.setattr(cm, "GRAM", gram)
    names, targets = _random_inputs(seed, 12, 400)
    got = _resolved(spark, names, targets, cm.resolve_city)
    assert got == {t: brute_simple(t, names) for t in targets}
    got = _resolved(spark, names, targets, cm.resolve_city_of_address)
    assert got == {t: brute_address(t, names) for t in targets}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(cm, "BROADCAST_MAX_ROWS", 0)
    names, targets = _random_inputs(3, 12, 300)
    got = _resolved(spark, names, targets, cm.resolve_city_of_address)
    assert got == {t: brute_address(t, names) for t in targets}


def test_known_cases(spark):
    got = _resolved(
        spark, NAMES,
        ["Tokyo Comedy Bar, Shibuya, Berlin", "Bar", "Hall • Old Tbilisi", "rio", "ŁÓDŹ ", "", "xyz", "Йошкар-Ола"],
        cm.resolve_city_of_address,
    )
    assert got == {
        "Tokyo Comedy Bar, Shibuya, Berlin": 0,
        "Bar": 1,  # three letters inside the longer 'barcelona', which comes first
        "Hall • Old Tbilisi": 5,
        "rio": 3,
        "ŁÓDŹ ": 9,
        "": None,
        "xyz": None,
        "Йошкар-Ола": 10,
    }


def test_hot_target_and_rows_are_kept(spark):
    df = spark.createDataFrame([("Berlin",)] * 300 + [(None,)] * 20 + [("Rio",)] * 5, "t string")
    rows = cm.resolve_city(df, _cities(spark, NAMES), "t").groupBy("t", "city._id").count().collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {("Berlin", "0", 300), (None, None, 20), ("Rio", "3", 5)}


def test_long_names_with_a_common_head(spark):
    head = "княжество " + "очень длинное название " * 8
    names = [f"{head}{i:04d}" for i in range(600)] + ["Рио"]
    targets = [f"{head}{i:04d}" for i in range(0, 600, 7)] + [head[:90], head[40:120], f"{head}9999", "0599", "599", "0 рио 599", "жество", "я", "q", ""]
    got = _resolved(spark, names, targets, cm.resolve_city)
    assert got == {t: brute_simple(" ".join(t.split()), names) if t.strip() else None for t in targets}
    texts = spark.createDataFrame([(f"{' '.join(head.split())} {i:04d}",) for i in range(0, 600, 7)], "text string")
    index = cm.build_index(_cities(spark, names))
    # Candidates of a text share its rarest gram, not the head that all names have in common.
    candidates = cm._rarest(texts, "text", index.grams).join(index.postings, "key").count()
    assert candidates < 12 * texts.count()


def test_plan_does_not_grow_with_names(spark):
    sizes = []
    for longest in (5, 400):
        names = ["x" * n + str(n) for n in range(1, longest, 3)]
        index = cm.build_index(_cities(spark, names))
        plan = cm.match_texts(spark.createDataFrame([("x",)], "text string"), index)._jdf.queryExecution().analyzed().toString()
        sizes.append(len(plan.splitlines()))
    assert sizes[0] == sizes[1]


def test_no_cities(spark):
    assert _resolved(spark, [], ["Rio", "x"], cm.resolve_city) == {"Rio": None, "x": None}
    assert _resolved(spark, [], ["Rio, x"], cm.resolve_city_of_address) == {"Rio, x": None}


def test_rows_are_read_once_for_their_targets_and_once_for_the_result(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    texts = ["Berlin", " BERLIN ", "Barcelona", "Rio Nuevo", "xyz", "", None] * 20
    rdd = spark.sparkContext.parallelize([(i, t) for i, t in enumerate(texts)], 2).map(seen)
    df = spark.createDataFrame(rdd, "id int, place string")
    rows = cm.resolve_city(df, _cities(spark, NAMES), "place").collect()
    assert read.value == 2 * len(texts)
    cities = {r["place"]: r["city"] and r["city"]["_id"] for r in rows}
    assert len(rows) == len(texts) and cities["Berlin"] == cities[" BERLIN "] == "0"
    assert cities["xyz"] is None and cities[""] is None and cities[None] is None
