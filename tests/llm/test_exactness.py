"""Plain versions of what SQL can't state: the classifier's forward pass, a recogniser of personal data, record layouts,
strings that defeat polynomial hashes, and long repetitive texts."""

import hashlib
import itertools
import json
import random
import re
from datetime import date, timedelta

import brute
import numpy as np
from pyspark.sql import functions as F

from curata.llm import chat, pii, substring, suffix, toxicity
from curata.llm import textnum as T

# ---------------------------------------------------------------- toxicity


def _plain_number(word: str) -> int:
    total, power, full = 0, 1, (1 << 64) - 1
    for b in word.encode():
        total, power = (total + (b + 1) * power) & full, power * 0x9E3779B97F4A7C15 & full
    x = total
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * m & full
    return x ^ (x >> 31)


def _plain_score(text, model):
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    rows = [int(model.number[_plain_number(w) >> 64 - toxicity.BITS]) for w in words] or [0]
    rows += [0] * 3
    feats = []
    for width, parts, bias in zip(toxicity.WIDTHS, model.tables, model.bias):
        best = None
        for k in range(max(1, len(words))):  # windows may run into the unknown words after the text
            v = sum(parts[j][rows[k + j]].astype(np.float64) for j in range(width))
            best = v if best is None else np.maximum(best, v)
        feats.append(np.maximum(best + bias, 0))
    logit = float(np.concatenate(feats) @ model.out + model.offset)
    votes = {lang: sum(w in own.split() for w in words) for lang, own in toxicity.FUNCTION_WORDS.items()}
    top = max(votes.values())
    lang = len(votes) if not top else list(votes.values()).index(top)
    return 1 / (1 + np.exp(-(logit - model.thresholds[lang])))


def test_scores_are_those_of_a_plain_forward_pass(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on(docs, labels)
    assert model.constant is None
    long = " ".join(r.text for r in docs.select("text").collect()) * 4  # more than one piece of a megabyte
    assert len(long) > T.PIECE
    texts = [r.text for r in docs.select("text").limit(60).collect()] + ["", None, "x", long]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in rows.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    assert all(abs(got[k] - _plain_score(t, model)) < 1e-4 for k, t in enumerate(texts))


# ---------------------------------------------------------------- personal data


def _luhn_ok(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def _shape(t):
    return re.sub("[0-9]", "9", t)


def test_dates_never_meet_and_stay_linked():
    key, day, seen, by_date = b"some key", date(1900, 1, 1), {}, {}
    while day.year < 2100:
        new = {}
        for form in ("{d:02d}/{m:02d}/{y}", "{m:02d}/{d:02d}/{y}", "{y}-{m:02d}-{d:02d}", "{d:02d}.{m:02d}.{y}"):
            text = form.format(d=day.day, m=day.month, y=day.year)
            out = pii.day(text, key)
            assert seen.setdefault(out, text) == text and _shape(out) == _shape(text)
            new[form] = out
        iso = new["{y}-{m:02d}-{d:02d}"]
        assert new["{d:02d}.{m:02d}.{y}"] == date.fromisoformat(iso).strftime("%d.%m.%Y")
        by_date[iso] = day
        day += timedelta(days=1)
    assert len(by_date) == 73049  # a permutation of all days
    assert pii.day("5 May 1980", key).split() == [str(int(x)) if k != 1 else x for k, x in enumerate(date.fromisoformat(pii.day("1980-05-05", key)).strftime("%d %B %Y").split())]


def test_forms_against_a_plain_recogniser():
    r, key = random.Random(3), b"some key"
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        d += next(c for c in "0123456789" if _luhn_ok(d + c))
        return " ".join(d[k:k + 4] for k in range(0, 16, 4))

    forms = {
        "card": (card, lambda t: _luhn_ok(re.sub(" ", "", t)) and re.fullmatch(r"\d{4}( \d{4}){3}", t)),
        "ip": (lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda t: all(0 <= int(x) <= 255 for x in t.split("."))),
        "ssn": (lambda: f"{r.randint(1, 600):03d}{' -'[r.randint(0, 1)]}", None),
        "phone": (lambda: f"+1 ({r.randint(200, 999)}) 555-{digits(4)}", lambda t: re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", t)),
        "email": (lambda: f"ab.{digits(3)}@mail.example", lambda t: re.fullmatch(r"[a-z]{2}\.\d{3}@mail\.example", t)),
        "date": (lambda: (date(1950, 1, 1) + timedelta(days=r.randint(0, 20000))).isoformat(), lambda t: date.fromisoformat(t)),
    }

    def ssn():
        sep = r.choice(" -")
        return f"{r.randint(1, 600):03d}{sep}{r.randint(1, 99):02d}{sep}{r.randint(1, 9999):04d}"

    forms["ssn"] = (ssn, lambda t: re.fullmatch(r"(?!000|666|9)\d{3}([ -])(?!00)\d\d\1(?!0000)\d{4}", t))
    known = {}
    for _ in range(300):
        kind = r.choice(list(forms))
        value = forms[kind][0]()
        out, spans = pii.replace(f"see {value}, or not", key)
        assert out.startswith("see ") and out.endswith(", or not") and spans == [f"{kind}:4:{4 + len(value)}"], (kind, value, out, spans)
        new = out[4:-8]
        assert forms[kind][1](new), (kind, value, new)
        assert known.setdefault((kind, value), new) == new
    assert len(set(known.values())) == len(known)
    for text in ("123 45 6789", "020 7946 0958", "5 May 1980", "Jan 7, 2001", "2001:db8::1", "josé@x.fr", "user@exämple.de", "fe80:0:0:0:1:2:3:4"):
        assert pii.replace(f"a {text} b", key)[0] != f"a {text} b", text
    for text in ("12:30:45", "std::vector", "a::b", "5.3.80", "1.2.3", "10 of 20", "v 2001"):
        assert pii.replace(f"a {text} b", key) == (f"a {text} b", []), text


def test_permutations_are_one_to_one():
    for size in (2, 3, 898, 1000, 4097):
        assert sorted(pii.permute(k, size, b"key", "t") for k in range(size)) == list(range(size))
    assert len({pii.ip(f"10.0.{a}.{b}", b"key") for a in range(40) for b in range(40)}) == 1600
    assert pii.ip("2001:db8:0:0::1", b"key") == pii.ip("2001:DB8::1", b"key")


def test_the_key_is_the_sessions(spark):
    assert pii.key_of(spark) == pii.key_of(spark) and len(pii.key_of(spark)) == 32
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.key_of(spark) == b"mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


# ---------------------------------------------------------------- chat layouts


def test_all_layouts_and_every_element(spark):
    part = lambda *t: [{"text": x} for x in t]
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "human", "content": "[1]"}]}, [("user", "a"), ("human", "[1]")]),
        ({"messages": [{"role": "gpt", "content": part("a", "b")}]}, [("gpt", "ab")]),
        ({"messages": [{"role": "user", "content": "[\"a\"]"}, {"role": "assistant", "content": part("b", "c")}, {"role": "x", "content": []}]}, [("user", "[\"a\"]"), ("assistant", "bc"), ("x", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"value": "r", "from": "gpt"}, {"from": "system", "value": None}]}, [("user", "q"), ("assistant", "r"), ("system", "")]),
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"response": "r", "system": "s", "prompt": "p"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o", "input": "x"}, [("system", "i"), ("user", "x"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "a"}, {"sender": "b", "body": "lost?"}]}, None),
        ({"messages": [{"role": "user", "content": part("a")}, {"role": "user", "content": [{"image": "x"}]}]}, None),
        ({"messages": {"role": "user", "content": "a"}}, None),
        ({"messages": []}, None),
        ({"prompt": "p", "response": {"text": "r"}}, None),
    ]
    table = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _) in enumerate(records)], "record_id long, record string")
    got = {}
    for x in chat.canonical(table).orderBy("record_id", "pos").collect():
        got.setdefault(x.record_id, []).append((x.role, x.text))
    assert got == {k: want for k, (_, want) in enumerate(records) if want is not None}
    assert {x.record_id for x in chat.unmapped(table).collect()} == {k for k, (_, want) in enumerate(records) if want is None}


def test_roles_are_read_back_as_given(spark, tmp_path):
    rows = [(c, t, role, f"text {c} {t}") for c, t in itertools.product(range(30), range(2)) for role in [("human", "gpt", "assistant", "user")[(c + t) % 4]]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r)[:5] for r in chat.op9_chat(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(brute.op9(rows))


# ---------------------------------------------------------------- substrings


def test_words_that_defeat_polynomials_stay_apart(spark):
    thue, other = "a", "b"
    while len(thue) < 1024:
        thue, other = thue + other, other + thue
    same = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([*same, thue])), (2, " ".join([*same, other])), (3, " ".join([*same, thue, "x" * 300])), (4, " ".join([*same, "x" * 301]))]
    out = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()]
    assert sorted(got) == sorted(brute.op5(rows))


def test_drawn_numbers_of_long_words_agree():
    data = np.frombuffer(("x" * 300 + " yz " + "x" * 300 + " yz").encode(), np.uint8)
    letters = T.letters(data, *T.spans(data, np.array([0, len(data)]))[:2])
    a = T.drawn(*letters, 0)
    assert a[0] == a[2] and a[1] == a[3] and a[0] != a[1]
    short = np.frombuffer(b"yz", np.uint8)
    assert T.drawn(*T.letters(short, *T.spans(short, np.array([0, 2]))[:2]), 0)[0] == a[1]


def test_long_uniform_and_periodic_texts(spark):
    line = "".join(random.Random(2).choice("abcdef ") for _ in range(90)) + "\n"
    cut = [(1, "a" * 3000), (2, line * 40), (3, "b" + "a" * 250 + line * 3), (4, "a" * 199), (5, line[:50] + line * 2 + "tail")]
    df = spark.createDataFrame(cut, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.deduplicate(df).collect()]
    assert sorted(got) == sorted(brute.op6(cut))
    sizes = []
    for text in ("a" * 1_500_000, line * 15_000):
        data = np.frombuffer(text.encode(), np.uint8)
        p, lo, hi, _ = suffix.samples(data, np.array([0, len(data)]))
        sizes.append(int(suffix._twice(data, p, lo, hi).sum()))
    assert max(sizes) < 1000  # rows sent for a text do not grow with its repeats
