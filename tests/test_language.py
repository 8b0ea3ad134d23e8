from __future__ import annotations

import itertools

import pytest

from pathsonde.functions import text
from pathsonde.lang import ast, introspect, parser
from pathsonde.lang.fields import Context

NOW = 1_785_000_000
CTX = Context(NOW, home="/home/u", users=(("ada", 1005),), groups=(("staff", 50),))


def read(text):
    return [[(a.negated, a.match) for a in g] for g in parser.parse(text, CTX).groups]


def one(text):
    ((pair,),) = read(text)
    return pair[1]


NAME = ast.NameContains


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Report", NAME("report")),
        ("a/B", ast.PathContains("a/b")),
        ("*.RS", ast.NameGlob("*.rs")),
        ('"two  words*"', NAME("two  words*")),
        ('"a/b*"', ast.PathContains("a/b*")),
        ("a/b*", ast.PathContains("a/b*")),
        ("ext:.RS;;toml", ast.Ext(("rs", "toml"))),
        ("ext:rs ; toml", ast.Ext(("rs", "toml"))),
        ("ext:", ast.Ext(())),
        ("path:", ast.PathContains("")),
        ("under:~/x/", ast.Under("/home/u/x")),
        ("under:~", ast.Under("/home/u")),
        ("under:/", ast.Under("/")),
        ("altinda:C:\\x\\", ast.Under("C:/x")),
        ("under:", NAME("under:")),
        ("child:/a", ast.ParentIs("/a")),
        ("size:1.5kb", ast.Size(">=", 1536)),
        ("size:<1e3", ast.Size("<", 1000)),
        ("size:=0", ast.Size("=", 0)),
        ("size:abc", NAME("size:abc")),
        ("kind:medya", ast.Kind(("audio", "video", "media"))),
        ("kind:image;code", NAME("kind:image;code")),
        ("pic:whatever", ast.Kind(("image",))),
        ("dm:7d", ast.Time("mtime", ">=", NOW - 7 * 86400)),
        ("dm:<3s", ast.Time("mtime", "<", NOW - 3 * 3600)),
        ("dm:=2w", ast.Time("mtime", "=", NOW - 14 * 86400)),
        ("dc:yesterday", ast.Time("ctime", ">=", NOW - 2 * 86400)),
        ("da:2026-2-31", ast.Time("atime", "=", 1772496000)),
        ("dm:2026-13-01", NAME("dm:2026-13-01")),
        ("node:symlink", ast.Bits("mode", 0o170000, 0o120000)),
        ("perm:644", ast.Bits("mode", 0o7777, 0o644)),
        ("perm:-200", ast.Bits("mode", 0o200, 0o200)),
        ("perm:+222", ast.Bits("mode", 0o222, 0, True)),
        ("perm:9", NAME("perm:9")),
        ("suid:", ast.Bits("mode", 0o4000, 0o4000)),
        ("ww:", ast.Bits("mode", 2, 0, True)),
        ("user:ada", ast.Num("uid", "=", 1005)),
        ("group:12", ast.Num("gid", "=", 12)),
        ("user:nobody-here", NAME("user:nobody-here")),
        ("depth:3", ast.Depth("=", 3)),
        ("depth:>3", ast.Depth(">", 3)),
        ("len:3", ast.NameLen(">=", 3)),
        ("regex:[A-Z]\\D", ast.Regex("[a-z]\\d")),
        ("fuzzy:abcd", NAME("abcd")),
        ("fuzzy:kitap", ast.NameNear("kitap", 1)),
        ("fuzzy:durusmatutanagi", ast.NameNear("durusmatutanagi", 2)),
        ("letters:sgr", ast.NameLetters("sgr")),
        ("case:README", ast.NameContainsCased("README")),
        ("content:Foo", ast.ContentContains("foo")),
        ("startwith:ab", ast.NameGlob("ab*")),
        ("c:/users", ast.PathContains("c:/users")),
        ("İSTANBUL", NAME("istanbul")),
        ("report (1).pdf"[:6], NAME("report")),
    ],
)
def test_one_term(text, want):
    assert one(text) == want


def test_structure():
    n = lambda t, neg=False: (neg, NAME(t))
    assert read("a;b") == [[n("a")], [n("b")]]
    assert read("a | b") == read("a|b") == read("a| b") == read("(a | b)") == read("<a|b>") == [[n("a"), n("b")]]
    assert read("( red | blue ) x") == [[n("red"), n("blue")], [n("x")]]
    assert read("rapor (1).pdf") == [[n("rapor")], [n("(1).pdf")]]
    assert read("!a|b") == [[n("a", True), n("b")]]
    assert read("a!b") == [[n("a")], [n("b", True)]] and read("hello!") == [[n("hello!")]]
    assert read("! a") == read("!a") == [[n("a", True)]]
    assert read("!size:1mb..2mb") == [[(True, ast.Size(">=", 1 << 20))], [(True, ast.Size("<=", 2 << 20))]]
    assert read("size:1mb..2mb|ext:pdf") == [[(False, ast.Size(">=", 1 << 20))], [(False, ast.Size("<=", 2 << 20)), (False, ast.Ext(("pdf",)))]]
    assert read("pic:|audio:") == [[(False, ast.Kind(("image",)))]]
    assert read("empty:") == [[(False, ast.IsDir(False))], [(False, ast.Size("=", 0))]]
    assert read("!empty:") == [[(True, ast.IsDir(False))], [(True, ast.Size("=", 0))]]
    assert read("!ext:rs;toml") == [[(True, ast.Ext(("rs", "toml")))]]
    assert read("startwith:a|b") == [[n("a"), (False, ast.NameGlob("b*"))]]
    assert read("") == read(" | ") == read('""') == read("!") == []


ALPHABET = ["a", " ", "|", "!", ";", '"', "(", ")", "<", "ext:", "size:", "kind:zip", "zz:", "*", "/", "..", ">", "1mb"]


def test_nothing_is_refused_and_spans_cover_everything():
    for parts in itertools.product(ALPHABET, repeat=3):
        text = "".join(parts)
        query = parser.parse(text, CTX)
        introspect.describe(query)
        spans = introspect.spans(text, CTX)
        assert [s.start for s in spans] == [0, *(s.end for s in spans)][: len(spans)] and (spans[-1].end if spans else 0) == len(text.encode())
        parser.forgiving_text(text)
        introspect.without(text, {"kind", "size"}, CTX)


def test_forgiving_text_agrees_with_the_query():
    for text in ("kitap", "kitap ext:pdf", "abcd", "!kitap", "kitap|raporlar x", '"some words" y', "durusma tutanagi"):
        soft = parser.forgiving_text(text)
        query = parser.parse(text, CTX)
        assert parser.parse(soft or text, CTX) == query.forgiving() and (soft is None) == (query.forgiving() == query)


def test_introspection():
    d = lambda t: introspect.describe(parser.parse(t, CTX))
    assert d("") == "any entry" and d("a|!b ext:rs;py") == "the name holds \u201ca\u201d, or it is untrue that the name holds \u201cb\u201d; the extension is rs/py"
    assert d("size:>10mb") == "the size is over 10 MB" and d("kind:image") == "the kind is image" and d("suid:") == "the mode includes set-user-id"
    assert d("dm:2026-01-02") == "the last change falls within 2026-01-02" and "up to 1 typing error," in d("fuzzy:kitap")
    every = "a a/b a* case:A fuzzy:kitap letters:abc len:3 regex:a under:/a parent:/a depth:2 ext:rs file: kind:image size:1 uid:1 perm:644 perm:/222 perm:-200 node:l dm:7d content:x items:3"
    assert d(every).count(";") == len(every.split()) - 1
    roles = lambda t: [s.role for s in introspect.spans(t, CTX)]
    assert roles('!ext:rs;py a* "b c"|zz:1') == ["not", "field", "colon", "value", "sep", "value", "space", "glob", "space", "quote", "phrase", "quote", "or", "unknown_field", "colon", "text"]
    assert roles("size:>1mb kind:zurna") == ["field", "colon", "cmp", "value", "space", "field", "colon", "bad_value"]
    assert [s.role for s in introspect.misread("kind:zurna zz:1 ok", CTX)] == ["bad_value", "unknown_field"]
    assert introspect.complete("si", 2) == ["size:"] and "kind:image" in introspect.complete("x kind:im", 9) and "dm:today" in introspect.complete("dm:t", 4)
    assert introspect.without("a kind:image dm:7d", {"kind"}, CTX) == "a dm:7d" and introspect.without("a kind:zurna", {"kind"}, CTX) is None
    assert introspect.with_term("a b", "b") == "a" and introspect.with_term("a", "b") == "a b"
    assert "size:" in introspect.syntax() and introspect.human_size(1536) == "1.5 KB"
    query = parser.parse("x content:foo content:bar", CTX)
    assert query.needs_content() and query.content_plan()[1] == ["foo", "bar"] and query.scored_terms() == ["x"]
    for bad in ("!content:x", "content:x|a"):
        with pytest.raises(ValueError):
            parser.parse(bad, CTX).content_plan()


def test_places_of_a_term():
    at = text.matches_at
    assert at("Raporu RAPOR", "rapor") == [(0, 5), (7, 12)] and at("Dilekçe", "dilekce") == [(0, 7)] and at("Dilekce", "dilekçe") == []
    assert at("Straße", "ss") == [(4, 5)] and at("a\u0301b", "ab") == [(0, 3)] and at("x", "") == []
