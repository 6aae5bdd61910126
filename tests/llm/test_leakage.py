import random

from litlens.llm.leakage import SuffixAutomaton, find_leaks, remove_leaks, words


def plain(text, known=None):
    return [w for w, _, _ in words(text, known)]


def test_words():
    assert plain('<p class="x">Big<b>ger</b> wor-\nld</p>co-op A1_b') == ["bigger", "world", "co", "op", "a1", "b"]
    assert plain("a well-\nknown", {"known"}) == ["a", "well", "known"] and plain("a res-\n  tart", {"restart"}) == ["a", "restart"]
    assert plain("p < 0.05 and x > 3") == ["p", "0", "05", "and", "x", "3"] and plain("") == []
    text = "One <i>two</i> three-\nfour"
    assert all(text[s] in "Otf" or text[s : s + 1].isalnum() for _, s, e in words(text))


def longest(items, doc):
    """Longest common run of words with each item, by brute force."""
    out = {}
    for k, seq in items.items():
        best = 0
        for i in range(len(seq)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(seq) and j + n < len(doc) and seq[i + n] == doc[j + n]:
                    n += 1
                best = max(best, n)
        out[k] = best
    return out


def test_automaton_against_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        items = {k: [rng.choice("abc") for _ in range(rng.randint(1, 9))] for k in range(4)}
        doc = [rng.choice("abcd") for _ in range(14)]
        for least in (1, 3):
            found, _ = SuffixAutomaton({k: [*v, f"\0{k}"] for k, v in items.items()}).leaks(doc, least)
            assert found == {k: n for k, n in longest(items, doc).items() if n >= least}


ITEM = "given a gold list of ten studies decide whether adding a synonym would raise recall more than precision today"


def test_find_and_remove(spark):
    cut = " ".join(ITEM.split()[3:15])
    docs = [(1, "Intro. " + cut.upper().replace(" ", ",\n") + " end of it"), (2, " ".join(ITEM.split()[3:14])), (3, None), (4, ""), (5, "word " * 100_000 + ITEM), (6, ITEM), (1, "Intro. " + cut)]
    items = [(7, ITEM, 0), (8, None, 0), (9, "", 0), (10, "too short", 0)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string, doc_id int")
    got = find_leaks(d, "doc_id", "text", i, "item_id", "text", 12)
    assert sorted((r.doc_id, r.item_id, r.longest) for r in got.collect()) == [(1, 7, 12), (1, 7, 12), (5, 7, 19), (6, 7, 19)]
    clean = {r.doc_id: r.clean_text for r in remove_leaks(d.where("doc_id <> 1"), "text", i, "item_id", "text").collect()}
    assert clean[6] is None and clean[3] is None and clean[4] == "" and clean[5] == "word " * 100_000 and clean[2] == docs[1][1]
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0 and find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


FORMS = "Die Prüfung der größten Übersichtsarbeit zeigt für ältere Schlafgestörte eine höhere Güte früher Suchläufe über mehrere Bücher"


def test_one_form(spark):
    import unicodedata

    wide = FORMS.translate({c: c + 0xFEE0 for c in range(0x41, 0x7B)})
    unseen = FORMS.replace("f", "f\u200b").replace("e", "e\u2060")
    docs = [(1, FORMS), (2, unicodedata.normalize("NFD", FORMS)), (3, wide), (4, unseen), (5, FORMS.upper()), (6, FORMS.replace("zeigt", "sagt"))]
    d, i = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame([(7, FORMS)], "i long, t string")
    assert sorted(r.d for r in find_leaks(d, "d", "t", i, "i", "t").collect()) == [1, 2, 3, 4, 5]
    around = spark.createDataFrame([(n, "Vorwort über Köpfe. " * 9 + t + " Ende ﬁn.") for n, t in docs[1:4]], "d long, t string")
    assert all(r.clean_text.startswith("Vorwort über Köpfe. ") and r.clean_text.endswith(" Ende ﬁn.") and len(r.clean_text) < 200 for r in remove_leaks(around, "t", i, "i", "t").collect())


def test_shards_find_the_same(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(30)) for _ in range(12)]
    docs = [(n, " ".join(texts[n % 12].split()[k : k + 15]) + " x " + texts[(n + 5) % 12]) for n, k in enumerate(range(0, 15))]
    d, i = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = lambda n: sorted(tuple(r) for r in find_leaks(d, "d", "t", i, "i", "t", 6, shard_words=n).collect())
    assert rows(10**6) == rows(70) == rows(1)
    cleaned = lambda n: sorted(tuple(r) for r in remove_leaks(d, "t", i, "i", "t", 6, 0.9, n).collect())
    assert cleaned(10**6) == cleaned(70)
