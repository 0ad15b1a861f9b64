import random

from strandmill.llm.leakage import ItemIndex, banded_distance, code_points, gram_hashes, leaked_items, words_of

DOCS = "doc long, body string, item long"
ITEMS = "item_no long, text string, lang string"


def brute(docs, items):
    found = set()
    for doc, text in docs:
        words = words_of(text)
        letters = "".join(words)
        runs = {tuple(words[i : i + 12]) for i in range(len(words) - 11)}
        for item, passage, lang in items:
            if item is None:
                continue
            own = words_of(passage)
            joined = "".join(own)
            if (lang or "").lower()[:2] in ("zh", "ja"):
                if any(joined[i : i + 24] in letters for i in range(len(joined) - 23)):
                    found.add((doc, item))
            elif any(tuple(own[i : i + 12]) in runs for i in range(len(own) - 11)):
                found.add((doc, item))
    return found


def leaked(spark, docs, items, **options):
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], DOCS)
    i = spark.createDataFrame(items, ITEMS)
    rows = [(r["key"], r["item"]) for r in leaked_items(d, "doc", "body", i, "item_no", "text", "lang", **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    lexicon = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    han = "的一是在不了有和人这中大为上个国"
    items, docs = [], []
    for k in range(30):
        if k % 3:
            items.append((k, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(8, 40))), rng.choice(["en", None, "ru"])))
        else:
            items.append((k, "".join(rng.choice(han) for _ in range(rng.randrange(20, 60))), rng.choice(["zh", "ja", "ZH-Hans"])))
    for d in range(150):
        item = rng.choice(items)
        words = item[1].split()
        if len(words) > 1:
            a = rng.randrange(len(words))
            part = rng.choice([" ", ", ", "\n", "-", "  "]).join(words[a : a + rng.randrange(9, 20)])
            if rng.random() < 0.3:
                part = part.replace(" ", "", 1)
            text = " ".join(rng.choice(lexicon) for _ in range(rng.randrange(20))) + rng.choice([" ", "", ". "]) + part.upper() + rng.choice([" ", "x", "."]) + rng.choice(lexicon)
        else:
            a = rng.randrange(len(item[1]))
            part = item[1][a : a + rng.randrange(20, 30)]
            text = "文" * rng.randrange(3) + part[:9] + rng.choice(["，", " \n", ""]) + part[9:] + "字"
        docs.append((d, text))
    expected = brute(docs, items)
    assert 20 < len(expected) < 150 * 30
    assert leaked(spark, docs, items) == expected
    assert leaked(spark, docs, items, block=300) == expected


def test_edits(spark):
    text = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew potions"
    changed = text.replace("jumps", "jumqs").replace("seven", "sevven")
    docs = [(1, "so " + changed + " end"), (2, text), (3, text.replace("o", "xx"))]
    items = [(7, text, "en")]
    assert leaked(spark, docs, items) == {(2, 7)}
    assert leaked(spark, docs, items, edits=2) == {(1, 7), (2, 7)}


def test_nulls_empty_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(14))
    docs = [(1, text), (1, text), (2, None), (3, ""), (4, " ­​ "), (5, "w" * 200_000 + " " + text)]
    items = [(1, text, None), (2, None, "en"), (3, "short", "en"), (None, text, "en"), (1, text, "de")]
    assert leaked(spark, docs, items) == {(1, 1), (5, 1)}
    assert leaked(spark, [], items) == set() and leaked(spark, docs, []) == set()


def test_format_characters_and_widths(spark):
    text = " ".join(f"word{i}" for i in range(12))
    assert leaked(spark, [(1, text.replace("word3", "wo­rd3").replace("word5", "ＷＯＲＤ５"))], [(1, text, "en")]) == {(1, 1)}


def test_kernels():
    codes = code_points("abcabcabcd")
    for q in range(1, 9):
        hashes = gram_hashes(codes, q)
        grams = ["abcabcabcd"[i : i + q] for i in range(11 - q)]
        assert len(hashes) == len(grams) and len(set(hashes.tolist())) == len(set(grams))
    assert banded_distance("kitten", "xxsittingxx", 3) == 2
    assert banded_distance("abc", "zzz", 1) == 2 and banded_distance("abc", "", 1) == 2
    assert ItemIndex([(1, "a b", "en")]).keys == []


def least_edits(passage, text):
    """Cell by cell: least edits of the passage against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(passage, 1):
        row, last = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_edited_passages_equal_brute_force(spark):
    rng = random.Random(9)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    items = [(k, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(12, 17))), "en") for k in range(12)]
    items.append((50, " ".join("abcdefghijkl"), "en"))  # twelve words of one letter
    docs = []
    for d in range(60):
        words = rng.choice(items)[1].split()
        a = rng.randrange(max(1, len(words) - 12))
        part = list(" ".join(words[a : a + rng.randrange(11, 15)]))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], [rng.choice("abcxyz")], [part[at], "q"]])
        docs.append((d, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(9))) + " " + "".join(part) + " " + rng.choice(lexicon)))
    expected = {}
    for d, text in docs:
        letters = "".join(words_of(text))
        for k, passage, _ in items:
            own = words_of(passage)
            edits = min(least_edits("".join(own[i : i + 12]), letters) for i in range(len(own) - 11))
            if edits <= 2:
                expected[d, k] = edits
    assert len(expected) > 25 and set(expected.values()) == {0, 1, 2}
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], DOCS)
    rows = leaked_items(d, "doc", "body", spark.createDataFrame(items, ITEMS), "item_no", "text", "lang", edits=2).collect()
    assert {(r["key"], r["item"]): r["edits"] for r in rows} == expected


def test_least_edits_where_a_passage_stands_twice(spark):
    text = "the quick brown fox jumps over the lazy dog while seven wizards"
    docs = [(1, text.replace("quick", "quack").replace("dog", "dig") + " and then " + text)]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], DOCS)
    rows = leaked_items(d, "doc", "body", spark.createDataFrame([(7, text, "en")], ITEMS), "item_no", "text", "lang", edits=2).collect()
    assert [(r["item"], r["edits"]) for r in rows] == [(7, 0)]
