from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

from pathsonde.llm import queries
from pathsonde.llm.pii import KINDS, disclosing_terms, find_spans, sanitise

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def secrets(text):
    """Long mixed runs outside of other spans."""
    taken = [(a, b) for _, a, b in plain(text)]
    out = []
    for m in re.finditer(r"[A-Za-z0-9]{16,}", text or ""):
        mixed = re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 8
        if mixed:
            out.append(("secret", m.start(), m.end(), all(b <= m.start() or a >= m.end() for a, b in taken)))
    return out


def base(r):
    return [(s.kind, s.start, s.end) for s in r.spans if s.kind in PATTERNS]


TEXTS = [
    "a@b.com_x@c.org, .@x.y a@b a@b. a@b..c x+y%z@sub.dom-ain.co.uk!", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.2.3", "9" * 5000,
    "4539 1488 0343 6467 and 4539-1488-0343-6467, 4539148803436467000 79927398713 5-5", "+1 (386) 555-3733 +1234567 +1 23456789012345 ++49 30 1234567. +5", "",
    None, "é🙂 mail@é.de mail@x.de 🙂 127.0.0.1", "a." * 4000 + "@b.c", "@@@ x@y.z@w.v", "1-2-3-4 5 6 7 8", "x" * 200_000 + "@a.b", "+1 " * 3000, "a@b.c," * 500,
]


def test_base_spans(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("ab19.@+-_ ()5", k=60)) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _h int")
    got = {r.doc_id: base(r) for r in find_spans(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: plain(r.text) for r in df.collect()}
    assert {r.doc_id: base(r) for r in find_spans(df).collect()} == want and sum(map(bool, want.values())) > 20


def entities(text):
    """Names of values, parts and kinds, and the text without values."""
    found = [*plain(text), *(x[:3] for x in secrets(text))]
    names, kinds = set(), {k for k, _, _ in found}
    for kind, a, b in found:
        v = text[a:b]
        v = re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v if kind == "secret" else v.lower()
        names.add((kind, v))
        if kind != "secret":
            names.add((kind + "~", {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": v[:6], "phone": v[:5]}[kind]))
    left, at = [], 0
    for a, b in sorted((a, b) for _, a, b in found):
        left.append(text[at : max(a, at)])
        at = max(at, b)
    return names, kinds, " ".join([*left, text[at:]])


def brute_terms(texts, min_texts=3, evidence=16.0, low=0.95):
    words = lambda t: {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 4}
    holders, both, df, marks = defaultdict(set), defaultdict(set), defaultdict(set), {}
    for i, t in enumerate(texts):
        names, kinds, rest = entities(t)
        marks[i] = frozenset(names)
        for w in words(t):
            df[w].add(i)
        for e in (*names, *((k, None) for k in kinds)):
            holders[e].add(i)
            for w in words(rest):
                both[e, w].add(i)
    best, n = {}, len(texts)
    for (e, w), rows in both.items():
        distinct, one = len({texts[i] for i in rows}), not e[0].endswith("~") and e[1] is not None
        rarity = math.log2(n / len(holders[e]))
        if distinct >= min_texts and rarity > 0 and distinct * rarity >= evidence and (one or len({marks[i] for i in rows}) > 1):
            best[w] = max(best.get(w, 0), math.log2(n * len(rows) / (len(df[w]) * len(holders[e]))) / rarity)
    return {w: ("remove" if s >= 0.999 else "generalise") for w, s in best.items() if s >= low}


def corpus():
    rng = random.Random(9)
    plainwords = ["river", "stone", "cloud", "table", "window", "garden", "letter", "paper"]
    texts = [" ".join(rng.choices(plainwords, k=30)) for _ in range(200)]
    for i in range(6):
        texts.append(f"{i} " + " ".join(rng.choices(plainwords, k=9)) + " Zarquon wrote from zed@mail.example.org about Blorbville stone " + " ".join(rng.choices(plainwords, k=40)))
    texts.append("later Blorbville was empty " + " ".join(rng.choices(plainwords, k=10)))
    return texts


def test_terms(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[-6:-1])], "doc_id long, text string")
    got = {r.term: r.action for r in disclosing_terms(df).collect()}
    assert got == brute_terms(texts + texts[-6:-1])
    assert got["zarquon"] == "remove" and got["blorbville"] == "generalise" and "stone" not in got
    out = sanitise(find_spans(df)).collect()
    assert all(x not in r.text for r in out for x in ("Zarquon", "zed@", "Blorbville"))
    clean = {r.doc_id: r.text for r in out if r.doc_id < 200}
    assert clean == dict(enumerate(texts[:200]))
    assert [k for k in (s.kind for s in out[200].spans)] == sorted((s.kind for s in out[200].spans), key=KINDS.index)


def test_documents_terms(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in df.collect()]
    got = {r.term: r.action for r in disclosing_terms(df, min_texts=1, evidence=1.0, generalise_at=0.9).collect()}
    assert got == brute_terms(texts, 1, 1.0, 0.9) and got
    assert {r.term: r.action for r in disclosing_terms(df).collect()} == brute_terms(texts)


def test_kinds_and_parts_disclose(spark):
    """The words that announce a secret, and the word of a domain, stand beside values that never recur."""
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choices(["river", "stone", "cloud", "table", "window"], k=40))
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    texts = [filler() for _ in range(300)]
    texts += [f'{filler()} token = "{key()}" {filler()}' for _ in range(12)] + [f"{filler()} token of thanks"]
    texts += [f"Zarquon {filler()} user{i}@zed.example.org" for i in range(8)] + ["copy wordlike " + filler() + " one@x.yz"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r.term: r.action for r in disclosing_terms(df).collect()}
    assert terms == brute_terms(texts) == {"token": "generalise", "zarquon": "remove"}
    out = {r.doc_id: r.text for r in sanitise(find_spans(df)).collect()}
    assert all("[secret]" in out[i] and "token" not in out[i] for i in range(300, 312)) and all(out[i] == texts[i] for i in range(300))


def test_many_hits_are_placed(spark):
    texts = ["a@b.cd x " * n for n in (127, 128, 129, 3000)]
    got = {r.doc_id: base(r) for r in find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    terms = brute_terms([r.text for r in rows])
    got = {r.doc_id: r for r in queries.op2_pii(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        own, text = plain(r.text), r.text or ""
        found = own + [x[:3] for x in secrets(text) if x[3]]
        words = [(terms[m[0].lower()], m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in terms]
        clear = [w for w in words if all(b <= w[1] or a >= w[2] for _, a, b in found)]
        spans = sorted(found + clear, key=lambda s: (KINDS.index(s[0]), s[1]))
        text_of = lambda ss: ",".join(f"{k}:{a}:{b}" for k, a, b in ss)
        g = got[r.doc_id]
        assert g.spans == text_of(spans) and g.base_sha256 == hashlib.sha256(text_of(own).encode()).hexdigest()
        assert [g[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in own) for k in PATTERNS]
        assert g.n_personal == len(found) and g.n_secret == len(found) - len(own)


def test_sanitise_and_empty(spark):
    rows = [(1, "x a@b.co, +1 (386) 555-3733 é 127.0.0.1", 0), (2, None, 0), (3, "", 0), (1, "x a@b.co, +1 (386) 555-3733 é 127.0.0.1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SPANS int")
    out = sorted((r.doc_id, r.text) for r in sanitise(find_spans(df)).collect() if r.text is not None)
    assert out == [(1, "x [email], [phone] é [ip]")] * 2 + [(3, "")]
    assert find_spans(df.limit(0)).count() == 0


def test_terms_far_from_the_entity(spark):
    """The name stands in the header, the address in the signature."""
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choices(["river", "stone", "cloud", "table", "window"], k=60))
    texts = [filler() for _ in range(100)] + [f"Zarquon {filler()} zed@mail.example.org" for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.term: r.action for r in disclosing_terms(df).collect()} == {"zarquon": "remove"}
    assert not any("Zarquon" in r.text for r in sanitise(find_spans(df)).collect())
