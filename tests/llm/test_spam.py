import random

from litlens.llm.spam import FEATURES, features, spam_pages

PROSE = "The reviewers disagreed on the abstracts, and the device was lost in the clinic on {} nights. After the visit, {} patients said that the treatment of their sleep had been easier than expected. "
SPAM = ["buy {0} cheap {0} best {0} price {0} online {0} shop {0} ", "http://{1}-shop.test/{0}?id={2}\n", "* [{0} top](http://{1}.test)\n", "#Neck{1} #Pillow{2} #{1}Care ", "{0} is the best {0} if you need {0} and {0} price. "]
FAIR = ["References\n" + "".join(f"{k}. {a} J. {b} in {c}. {d} Med 200{k % 10};{k}:10. https://doi.org/10.1000/x{k}{{}}\n" for k, (a, b, c, d) in enumerate(zip("Doe Roe Poe Lee Coe Moe Noe Zoe".split(), "Sleep Mood Gait Pain Fatigue Memory Snoring Anxiety".split(), "nurses drivers twins teachers cadets adults women men".split(), "J Ann Arch Acta Rev Int Eur Am".split()))), '# Q1: Balanced\n("sleep"[tiab] OR "insomnia"[tiab] OR "apnea {}"[tiab]) AND ("nurses"[Mesh] OR "drivers"[Mesh])', "Abbreviations\n" + "SQ: sleep quality {}\nMS: mental state\nPT: parent training\n"]


def pages(n=240):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgilmno") for _ in range(6))
    rows = []
    for i in range(n):
        if i % 4 == 0:
            kind, key = SPAM[(i // 4) % len(SPAM)], word() + " " + word()
            rows.append((i, "".join(kind.format(key, word(), rng.randint(1, 999)) for _ in range(20)), "bad" if i % 8 else None, 1))
        elif i % 4 == 1:
            rows.append((i, FAIR[(i // 4) % 3].replace("{}", str(i)), "good", 0))
        else:
            rows.append((i, "".join(PROSE.format(rng.randint(1, 99), word()) for _ in range(rng.randint(1, 12))), "good", 0))
    return rows


def test_features():
    assert features("") is None and features("two words") is None and len(features(PROSE)) == len(FEATURES)
    assert all(0 <= v < 50 for v in features("snore strap " * 50_000))


def test_spam_pages(spark):
    rows = pages() + [(1000, None, "good", 0), (1001, "", None, 0), (1002, "short text", "bad", 0)]
    df = spark.createDataFrame(rows, "score long, text string, host string, truth int")
    got = {r["score_id"]: r for r in spam_pages(df.withColumnRenamed("score", "score_id"), "score_id", "text", "host").collect()}
    wrong = [r[0] for r in rows if got[r[0]].is_spam != bool(r[3])]
    assert len(got) == len(rows) and len(wrong) <= 0.02 * len(rows), wrong
    assert got[1000].score == got[1001].score == got[1002].score == 0


def test_one_class_and_empty(spark):
    prose = spark.createDataFrame([(i, PROSE.format(i, i) * 3, "h") for i in range(20)], "id long, t string, h string")
    assert spam_pages(prose, "id", "t", "h").where("is_spam").count() == 0 and spam_pages(prose.limit(0), "id", "t", "h").count() == 0
