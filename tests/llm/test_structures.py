"""Whitening, conversation trie and HTML extraction against brute force and hand-made cases."""
import hashlib
import html as markup
import math
import random
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from mailwarden.llm import html_text, prefix_trie, queries, whitening
from mailwarden.llm.html_text import main_text

# ---------------------------------------------------------------- whitening


def whitened(df, **options):
    return [r.asDict() for r in whitening.whiten(df, **options).collect()]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, n string, x string")


@pytest.fixture(scope="module")
def embedded(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    rows = [(i, [float(v) for v in rng.normal(size=6) @ mix], "clash", "clash", "clash") for i in range(120)]
    rows += [(1000 + i, rows[3][1], None, None, None) for i in range(60)] + [rows[5]]
    bad = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [math.nan] * 6), (2003, [math.inf] + [0.0] * 5)]
    return vectors(spark, rows + [(k, v, "", "", "") for k, v in bad]), rows


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening(embedded, weights):
    df, rows = embedded
    got = whitened(df, weights=weights)
    x = {k: tuple(math.floor(256 * float(np.float32(c))) for c in v) for k, v, *_ in rows}
    all_x = [x[k] for k, *_ in rows]
    distinct = sorted(set(all_x))
    w = np.array([all_x.count(v) if weights == "counts" else 1 for v in distinct])
    n, m = int(w.sum()), np.array(distinct, dtype=object)
    sums = (m * w[:, None]).sum(axis=0)
    mean = np.array([s / n for s in sums])
    centred = m.astype(float) - mean
    values, basis = np.linalg.eigh(centred.T @ (centred * w[:, None]) / n)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        c = r["component"] - 1
        v = np.array(x[r["vec_id"]], dtype=object)
        assert r["deviation"] == sum(int(d) ** 2 for d in n * v - sums)
        want = float((v.astype(float) - mean) @ basis[:, c] / math.sqrt(values[c]))
        if abs(want) > 1e-6:
            assert signs.setdefault(c, math.copysign(1, want * r["whitened"])) == math.copysign(1, want * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_whitening_defined_cases(spark):
    assert whitened(vectors(spark, [])) == []
    assert whitened(vectors(spark, [(1, None, "", "", ""), (2, [math.nan], "", "", "")])) == []
    assert whitened(vectors(spark, [(1, [], "", "", "")])) == []
    one = whitened(vectors(spark, [(1, [0.5, -0.001], "", "", ""), (1, [0.5, -0.001], "", "", "")]))
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [
        (c, 1, 0, None, None, None) for c in (1, 1, 2, 2)]
    line = whitened(vectors(spark, [(i, [float(i), 0.0], "", "", "") for i in range(5)]))      # one direction of variance
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert all(r["explained"] == pytest.approx(2 - r["component"]) and r["identity_error"] < 1e-9 for r in line)
    short = whitened(vectors(spark, [(1, [1.0], "", "", ""), (2, [1.0, 2.0, 3.0], "", "", ""), (3, [2.0, 0.0], "", "", "")]))
    assert {r["vec_id"] for r in short} == {1, 2, 3} and {r["n"] for r in short} == {3}
    huge = whitened(vectors(spark, [(1, [3e38, 1.0], "", "", ""), (2, [-3e38, 2.0], "", "", ""), (3, [0.0, 1.0], "", "", "")]))
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and all(r["deviation"] is None for r in huge if r["vec_id"] < 3)


def test_whitening_of_many_copies(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)] if i % 3 else [1.0, 2.0, 3.0], "", "", "") for i in range(3000)]
    got = whitened(vectors(spark, rows))
    assert len(got) == 9000 and {r["n"] for r in got} == {2001} and max(r["identity_error"] for r in got) < 1e-9


# ---------------------------------------------------------------- trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth string, conv string"


def trie_rows(sequences):
    """Brute force: {conv: [(role, text), ...]} to the expected rows."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        listed = ",".join(str(c) for c in sorted(ends[p]))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m),
                    sum(len(q) == len(p) + 1 and q[:-1] == p for q in members), len(leaves), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def own_turns(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[-1] for t in sorted(v)] for c, v in turns.items()}


def rebuilt(rows):
    own, out = own_turns(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def got_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def chats(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 130), *range(198, 215), 305, -7, -100, -150]:
        if c % 7 == 0:
            rows += [(c, t, "user", "same", "", "", "") for t in range(3)]
            continue
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé😀", "", None, "long " * 40]), "x", None, "y"))
    rows += [(4, None, "user", "no turn", "", "", ""), (4, 2, "user", "tie", "", "", ""), (4, 2, "user", "tie", "", "", ""), (None, 1, "user", "lost", "", "", "")]
    rows += [(500, t, "user", f"{t % 3}", "", "", "") for t in range(41)] + [(501, t, "user", f"{t % 3}", "", "", "") for t in range(64)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), rows


def test_trie_of_rebuilt_conversations(chats):
    df, rows = chats
    assert got_rows(prefix_trie.conversation_trie(df)) == trie_rows(rebuilt(rows))


def test_trie_of_conversations_as_they_are(chats):
    df, rows = chats
    assert got_rows(prefix_trie.plain_trie(df)) == trie_rows(own_turns(rows))


def test_trie_without_turns_left(spark):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 99)}
    rows = [(c, 0, "user", "only", "", "", "") for c in h if h[c] >= 1][:4]       # base 0 is absent
    df = spark.createDataFrame(rows, SCHEMA)
    ids = ",".join(str(r[0]) for r in rows)
    assert got_rows(prefix_trie.conversation_trie(df)) == [(rows[0][0], 0, None, 4, 0, 1, 0, hashlib.sha256(ids.encode()).hexdigest())]
    assert got_rows(prefix_trie.conversation_trie(df.limit(0))) == []


def test_ids_of_a_large_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rows = [(c, t, "u", "same", "", "", "") for c in range(3000, 0, -1) for t in range(2)]
    got = prefix_trie.plain_trie(spark.createDataFrame(rows, SCHEMA)).filter("depth = 2").collect()
    assert [(r["conv_id"], r["n_convs"], r["saved_tokens"]) for r in got] == [(1, 3000, 2999 * 4)]
    assert got[0]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(1, 3001))).encode()).hexdigest()


# ---------------------------------------------------------------- HTML

PROSE = "The quick report that was on the desk of the editor is about the weather and it has been there for a week, as they say."
LONGER = PROSE + " " + PROSE


class Article(HTMLParser):
    """Independent reading of the given pages: blocks of what stands between <article> and its end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_given_pages(spark, sf):
    wanted = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a = Article()
        a.feed(r["html"])
        a.close()
        text = "\n\n".join(b for b in (" ".join(b.split()) for b in a.blocks) if b)
        wanted[r["page_id"]] = (r["url"], text, len(text))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.QUERIES["op13_html_extraction"](spark, sf).collect()}
    assert got == wanted and all(v[2] for v in got.values())


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<html><body></body></html>", ""), ("plain words", "plain words"),
    (f"<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>Short.</p><p>{PROSE}</p><p>End &amp; &eacute;&#233;&nbsp;&bogus;</p></article><footer>{PROSE}</footer>",
     f"Title\n\nShort.\n\n{PROSE}\n\nEnd & éé &bogus;"),
    ("<article><p>Zwrx qqt.</p><p>" + "zzkq xvbn " * 40 + "</p></article>", "Zwrx qqt.\n\n" + ("zzkq xvbn " * 40).strip()),
    (f"<article><p>{PROSE}</p><div class='ad-box'>Buy the new one of these now, it is for you and for all.</div><p>a  b\n\tc<br>d</p></article>", f"{PROSE}\n\na b c d"),
    (f"<main><p>{PROSE}</p><section id=comments><p>{LONGER}</p></section></main>", PROSE),
    (f"<article><p>{PROSE}</p></article><div class=comment-list><article class=comment><p>{PROSE}</p></article></div>", PROSE),
    (f"<aside><p>{LONGER}</p></aside><div class='content no-sidebar'><h2>Head</h2><p>{LONGER}</p><p>Short one.</p></div><div class=cookie-notice>{LONGER}</div>",
     f"Head\n\n{LONGER}\n\nShort one."),
    (f"<div><a href=/>One</a> <a href=/>Two</a></div><div><p>{LONGER}</p></div><div>{'<a href=/>linked words here</a> ' * 9}</div>", LONGER),
    (f"<header><p>{LONGER}</p></header><article><header><h1>Own title</h1></header><p>{PROSE}</p></article>", f"Own title\n\n{PROSE}"),
    (f"<article><p>{PROSE}<script>var t = '</p><p>{PROSE}';</script><style>p {{}}</style><!-- <p>no</p> --> tail<form><p>Name</p></form></article>", f"{PROSE} tail"),
    (f"<article><p title='a > b'>{PROSE}<p>1 < 2 and 3 > 2</article>", f"{PROSE}\n\n1 < 2 and 3 > 2"),
    (f"<article><p>{PROSE}<p>cut &am", f"{PROSE}\n\ncut &am"), (f"<article><p>{PROSE}<p class='x", PROSE), (f"<article><p>{PROSE}<!-- open", PROSE),
    (f"<article><p>{PROSE}<p><a href=/>Read the study</a></p><ul><li><a href=/>Other page</a></li></ul></article>", f"{PROSE}\n\nRead the study"),
    (f"<p><!-->{LONGER}</p>", LONGER), (f"<article><p>{PROSE}</p><div hidden>{PROSE}</div><div style='display: none'>x</div></article>", PROSE),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_short_blocks_follow_their_neighbours():
    menu = "<div>" + "<a href=/>one link</a> " * 12 + "</div>"
    page = f"<div>Lost</div>{menu}<p>Left</p><h3>Over the text</h3><p>{LONGER}</p><p>Yes.</p><p>Also.</p><p>{LONGER}</p><p>Last.</p>"
    assert main_text(page).split("\n\n") == ["Over the text", LONGER, "Yes.", "Also.", LONGER, "Last."]


def test_pages_of_any_form_are_read_in_linear_time(spark):
    long_text = "word the of " * 400000
    odd = ["<" * 200000, "<a " * 100000, "</" * 100000, "<!--" * 100000, "<svg>" * 50000, "<div>" * 100000 + "x", "&" * 200000, "<p a='" * 60000,
           "<article>" + long_text + "</article>", "<b>" * 50000 + PROSE]
    rows = [(i, "u", p, "clash") for i, p in enumerate(odd)] + [(None, None, None, "x"), (99, "u", "", "x"), (50, "u", "<p>hi", "y"), (50, "u", "<p>hi", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.html_text(df).collect()
    by_id = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and by_id[8]["text"] == " ".join(long_text.split()) and by_id[8]["n_chars"] == len(by_id[8]["text"])
    assert (by_id[None]["url"], by_id[None]["text"], by_id[None]["n_chars"]) == (None, "", 0) and by_id[99]["text"] == ""
    assert sum(r["page_id"] == 50 for r in got) == 2
    assert html_text.html_text(df.limit(0)).collect() == []


def test_references_are_decoded_once():
    assert main_text("<article><p>&amp;lt; " + PROSE + " &lt;b&gt; &copy; &#x1F600;</p></article>") == markup.unescape("&amp;lt;") + " " + PROSE + " <b> © 😀"
