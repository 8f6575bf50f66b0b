import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cinequarry.llm import urls


def naive(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in urls.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


ODD = [None, "", "://", "no scheme/com/", "http://com/", "http://xcom/", "http://a.COM/x", "http://a.com", "http://a.com?x=/", "HTTP://WWW.Example.com/en/1#f", "http://example.com/en", "http://example.com/en/", "http://e.net/es/x", "http://e.net/ES/x", "a://b://c.net/fr/", "http://É.com/ü?q", "http://x.org/\ny/", "http://h" + "/long" * 5000, "http://com:80/", "http://x.example.com.net/fr/"]


def pages():
    rng = random.Random(4)
    out = list(ODD)
    for _ in range(400):
        host = rng.choice(["a.com", "b.net", "www.example.com", "spam.org", "c.org"])
        out.append(f"http://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(0, 999)}")
    return out


def test_rules_and_models(spark):
    rows = [(i, u, "x") for i, u in enumerate(pages())] + [(7, ODD[7], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(3)
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, _ in rows:
        host, path, rule, verdict = naive(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert by[i].verdict == (verdict or by[i].verdict) and by[i].verdict in ("allow", "block")
    want, least = brute(sorted({(u or "", naive(u)[3]) for _, u, _ in rows}, key=str))
    for i, u, _ in rows:
        score = want.get(u or "")
        assert (by[i].score is None) == (score is None) and (score is None or abs(by[i].score - score) < 2e-6)
        assert by[i].verdict == (naive(u)[3] or ("allow" if score >= least else "block"))
    again = {r.page_id: (r.verdict, r.score) for r in urls.judge(df.repartition(6)).collect()}
    assert again == {i: (r.verdict, r.score) for i, r in by.items()}


def places(u):
    s = "\2" * urls.ORDER + re.sub("[0-9]", "0", re.sub("[^\\x00-\\x7f]", "\x80", u)) + "\3"
    for i in range(urls.ORDER, len(s)):
        yield [(s[i - n : i], s[i]) for n in range(urls.ORDER + 1)]


def brute(met):
    """Scores of the urls that don't train, and the threshold, by dictionaries of whole contexts."""
    grams, contexts = (Counter(), Counter()), (Counter(), Counter())
    trains = lambda u, v: v is not None and hashlib.md5(u.encode()).hexdigest()[0] < "8"
    for u, v in met:
        if trains(u, v):
            for place in places(u):
                grams[v == "block"].update(place)
                contexts[v == "block"].update([c for c, _ in place])

    def score(u):
        total = []
        for place in places(u):
            p = [1 / urls.ALPHABET] * 2
            for c, x in place:
                p = [(grams[k][c, x] + p[k] * urls.BACKOFF) / (contexts[k][c] + urls.BACKOFF) for k in (0, 1)]
            total.append(math.log(p[0] / p[1]))
        return sum(total) / len(total)

    scores = {u: score(u) for u, v in met if not trains(u, v)}
    held = [(math.floor(scores[u] * urls.STEPS), v) for u, v in met if v and u in scores]
    n = Counter(v for _, v in held)
    best, last = None, None
    for s in sorted({s for s, _ in held}):
        right = sum(v == "allow" and x >= s for x, v in held) / n["allow"] + sum(v == "block" and x < s for x, v in held) / n["block"]
        if best is None or right > best[0] + 1e-12:
            best = (right, s if last is None else (s + last + 1) / 2)
        last = s
    return scores, best[1] / urls.STEPS


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    make = lambda bad: "http://" + ("".join(rng.choice("xzq") for _ in range(6)) if bad else "".join(rng.choice("aeilnrst") for _ in range(6))) + ".org/" + str(rng.randint(0, 99))
    rows = [(make(i % 3 == 0), ("block" if i % 3 == 0 else "allow") if i < 400 else None) for i in range(600)]
    bad = {u for i, (u, _) in enumerate(rows) if i % 3 == 0}
    scores, least = urls.scored(spark.createDataFrame(rows, "url string, verdict string").distinct())
    held = [r for r in scores.collect() if (r.url, None) in rows]
    assert len(held) > 150 and sum((r.score >= least) == (r.url not in bad) for r in held) / len(held) > 0.97


def test_frequent_grams_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(pages())], "page_id long, url string")
    whole = sorted(map(tuple, urls.judge(df).select("page_id", "verdict", "score").collect()))
    monkeypatch.setattr(urls, "FREQUENT", 20)
    assert sorted(map(tuple, urls.judge(df).select("page_id", "verdict", "score").collect())) == whole


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(df).collect()] == ["allow"]
    assert urls.judge(df.where(F.lit(False))).count() == 0
