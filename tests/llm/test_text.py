import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import blocks, personal, repeated_lines, residue, splitting
from corvane.llm.line_rules import label_lines

DOCS = "doc_id long, url string, title string, text string, site string, evidence int, n int"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


# -- 1: splitting ---------------------------------------------------------------------------------------------------


def check_pieces(text, words=256, chars=2000):
    got = splitting.split_text(text, words, chars)
    for s, e in got:
        assert e - s <= chars and len(text[s:e].split()) <= words
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= len(text) and b < d and c <= b + len(text[b:]) - len(text[b:].lstrip())
    covered = set()
    for s, e in got:
        covered |= set(range(s, e))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    return got


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="abc é.\n　!", min_size=0, max_size=60), max_size=40), st.integers(3, 20), st.integers(30, 120))
def test_pieces_keep_the_limit_and_every_word(parts, words, chars):
    check_pieces(" ".join(parts), words, chars)


def test_natural_cuts_and_overlap():
    text = "\n\n".join(" ".join(f"Sentence {i} of paragraph {p} says something plain here." for i in range(12)) for p in range(6))
    got = check_pieces(text)
    assert all(text[e - 1] == "." for _, e in got)
    shared = [len(text[b:a].split()) for (_, a), (b, _) in zip(got, got[1:])]
    assert all(15 <= n <= 45 for n in shared)
    check_pieces("x" * 9000)
    check_pieces("日本語の文です。" * 900)
    assert splitting.split_text("See fig. 3 and no. 4. " * 3, 8, 200)[0] == (0, 21)


def test_split_operator(spark):
    long = "One two three. " * 200
    rows = [("a", 1, long, 100, 100 + len(long), ["H"], 1), ("a", 1, long, 100, 100 + len(long), ["H"], 1), ("b", 2, "short", 0, 5, None, 1), ("c", None, None, None, None, None, 1), ("d", 3, "", 0, 0, [], 1), ("e", 3, " " * 2500, 0, 2500, [], 1)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id long, text string, start_char int, end_char int, heading_path array<string>, oversized int")
    got = splitting.split_oversized(df).orderBy("chunk_id", "piece_no").collect()
    a = [r for r in got if r.chunk_id == "a"]
    assert [r.piece_no for r in a] == list(range(len(a))) and len(a) > 2 and all(r.heading_path == ["H"] and r.oversized for r in a)
    assert all(long[r.start_char - 100 : r.end_char - 100] == r.text for r in a)
    rest = {r.chunk_id: (r.text, r.oversized) for r in got if r.chunk_id != "a"}
    assert rest == {"b": ("short", False), "c": (None, False), "d": ("", False), "e": ("", True)}
    assert splitting.split_oversized(df.limit(0)).count() == 0


# -- 6: repeated lines ----------------------------------------------------------------------------------------------


def test_repeated_lines(spark):
    rows = [(i, "http://WWW.a.test:80/x", "t", f"Back to TOP!\nown line {chr(97 + i)}{chr(98 + i)}\n12\nBack to top") for i in range(6)]
    rows += [(10 + i, "https://b.test/", None, "back to top") for i in range(4)] + [(20, None, "t", "back to top"), (21, "http://a.test", "t", None), (22, "http://a.test", "t", ""), (0, "http://www.a.test/x", "t", rows[0][3])]
    lines, found = repeated_lines.repeated_lines(docs(spark, rows))
    assert [(r.site, r.line_key, r.n_docs, r.n_occurrences) for r in lines.collect()] == [("a.test", "backtotop", 6, 12)]
    assert sorted((r.doc_id, r.line_no) for r in found.collect()) == [(i, k) for i in range(6) for k in (0, 3)]
    clean = {r.doc_id: (r.text, r.n_removed) for r in repeated_lines.without_repeated_lines(docs(spark, rows[1:])).collect()}
    assert clean[1] == ("own line bc\n12", 2) and clean[21] == (None, 0) and clean[22] == ("", 0)
    assert repeated_lines.repeated_lines(docs(spark, rows).limit(0))[1].count() == 0


# -- 4: residue -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["Call {{ name }} today.", "We serve <city> well", "Dear *|FIRST|*, hello", "Led by null null.", "TODO: describe the shop", "Your text here.", "Prices at [price].", "(add a photo here)"])
def test_slots(text):
    assert residue.has_slot(text)


@pytest.mark.parametrize("text", ["Write {{first_name}} in the field.", "A [sic] was added", "The null result", "[Home] [Blog]", "x@y.example and (at) z", "To-do lists help", "Placeholder text is a pity", "cost < 5 and > 3", "#1 in town", "100% of it"])
def test_no_slots(text):
    assert not residue.has_slot(text)


def test_filler():
    assert residue.is_filler("Lorem ipsum dolor sit amet, consectetur adipiscing elit") and residue.is_filler("Caption teaser wording subhead dummy copy text here")
    assert not residue.is_filler("Printers have set lorem ipsum as dummy text for centuries") and not residue.is_filler("The copy of the text goes to the client")


def test_residue_operator(spark):
    menu = "About us · Shop\n"
    body = "Plain words about the drain and the pipe in the yard of the house " * 4
    rows = [
        (1, "http://a.test", "ok", menu + body), (2, "http://a.test", "x", menu + "404 Not Found\nThe page you asked for is not on this server."), (3, "http://a.test", "[PAGE TITLE]", body), (4, "http://a.test", "x", "You need to enable scripts to run this app."),
        (5, "http://a.test", "{{x}}", ""), (6, None, None, None), (7, "http://a.test", "x", "Access denied\n" + body.replace("drain", "roof")), (8, "http://a.test", "x", body + "\nLorem ipsum dolor sit amet elit sed do."), (2, "http://a.test", "x", menu + "404 Not Found\nThe page you asked for is not on this server."),
    ]
    got = {r.doc_id: r.evidence for r in residue.residue(docs(spark, rows)).collect()}
    assert got == {1: None, 2: "message", 3: "slot", 4: "message", 5: None, 6: None, 7: None, 8: "filler"}
    # a footer too long to weigh as nothing, but the same on three pages
    foot = "\nWe are a long footer that says the same words over and over on each of the pages of this site so that nobody can miss them whatever page they open on whichever day of the year it is"
    rows = [(i, "http://f.test", "x", "Page not found" + foot) for i in range(3)] + [(9, "http://g.test", "x", "Page not found" + foot)]
    assert {r.doc_id: r.evidence for r in residue.residue(docs(spark, rows)).collect()} == {0: "message", 1: "message", 2: "message", 9: None}
    assert residue.residue(docs(spark, rows).limit(0)).count() == 0


def test_marks_agree_with_the_jvm(spark):
    df = spark.createDataFrame([("a.test", "Back to Top 1 É")], "site string, line string")
    k = repeated_lines.line_key(F.col("line"))
    r = df.select(F.xxhash64("site", k).alias("m"), k.alias("k")).first()
    assert r.k == residue.key_of("Back to Top 1 É") and r.m == residue.mark_of("a.test", r.k)


# -- 5: main body ---------------------------------------------------------------------------------------------------

PAGE = """About us · Blog · Shop
You are here: Shop > Clearing a drain
Clearing a drain
By Grace Miller
A blocked drain is cleared from the lowest point first, and the water is let off slowly so that nothing floods the yard. Then the pipe is rinsed.
Share this article on your favourite network
- The rod is long and the bend is narrow, so the work takes two people.
Related articles
- Choosing a rod in Halford or Marston
Mending a pipe in Ostwick and Velham
Back to top
© 2020 Some Yard. All rights reserved."""


def test_page_body():
    s = dict(blocks.Tagger().states(PAGE, "Clearing a drain - Some Yard"))
    assert [k for k, v in sorted(s.items()) if v == 0] == [2, 4, 6]
    assert [k for k, y in enumerate(label_lines(PAGE.split("\n"))) if y == 0] == [2, 4, 6]


def test_body_operator(spark):
    rows = [(1, "u", "Clearing a drain", PAGE), (1, "u", "Clearing a drain", PAGE), (2, None, None, None), (3, "u", None, ""), (4, "u", None, "\n \n​"), (5, "u", "t", "word " * 50_000)]
    found = blocks.boilerplate_lines(docs(spark, rows)).collect()
    assert sorted(r.line_no for r in found if r.doc_id == 1) == [0, 1, 3, 5, 7, 8, 9, 10, 11] and not {r.doc_id for r in found} - {1}
    bodies = {r.doc_id: r.body for r in blocks.main_bodies(docs(spark, rows)).collect()}
    assert bodies[1].startswith("Clearing a drain\nA blocked") and bodies[2] is None and bodies[3] == "" and len(bodies[5]) > 200_000
    assert blocks.boilerplate_lines(docs(spark, rows).limit(0)).count() == 0


# -- 9: personal data -----------------------------------------------------------------------------------------------

NAMES = personal.Names(["Grace", "Will", "May"], ["Fenmartsen", "Ganliver", "Korkomsen", "Halsoger", "Marwamper", "Hesnaxez", "Kalpathez", "Orbodez", "Norrikez"])


def spans(text):
    return [(text[a:e], k) for a, e, k in personal.find(text, NAMES, personal.model(personal.MODEL))]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to a.b+c@mail.x.example for it.", [("a.b+c@mail.x.example", "email")]),
        ("Info: nadia27 (at) kes (dot) example (dot) org now", [("nadia27 (at) kes (dot) example (dot) org", "email")]),
        ("Call +44 (0)1632 960 563 after six.", [("+44 (0)1632 960 563", "phone")]),
        ("Tel. 030/23125-495.", [("030/23125-495", "phone")]),
        ("Part no. 490-60-4376 replaces it. Batch 224 630 4851 left.", []),
        ("His social security number is 993-89-8782, as shown.", [("993-89-8782", "id_number")]),
        ("We were given tax ID 00 098 931 531 by mistake.", [("00 098 931 531", "id_number")]),
        ("Deliver to Flat 3, 84 Rasmere Lane, Torhaven QV17 7ZZ.", [("Flat 3, 84 Rasmere Lane, Torhaven QV17 7ZZ", "address")]),
        ("Livré au 117 bis avenue Nordcombe, 00752 Rasholm.", [("117 bis avenue Nordcombe, 00752 Rasholm", "address")]),
        ("Anschrift: Nevilbystr. 91, D-00972 Jorness.", [("Nevilbystr. 91, D-00972 Jorness", "address")]),
        ("Ask for Mrs Grace Fenmartsen at the desk.", [("Grace Fenmartsen", "name")]),
        ("BY FENMARTSEN, GRACE\nx", [("FENMARTSEN, GRACE", "name")]),
        ("Fenmartsen & Daughters has a stall.", []),
        ("Follow @some_yard for pictures; the at sign @ is not part.", []),
        ("", []),
    ],
)
def test_personal_data(text, want):
    assert spans(text) == want


def test_offsets_count_hidden_characters():
    text = "A­b c. Ask for Gra​ce Fenmartsen at the desk."
    (a, e, k), = personal.find(text, NAMES, personal.model(personal.MODEL))
    assert text[a:e] == "Gra​ce Fenmartsen" and k == "name"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.tuples(st.integers(0, 4), st.integers(1, 4), st.sampled_from(personal.KINDS), st.floats(-3, 5)), max_size=6), st.lists(st.floats(-2, 2), min_size=36, max_size=36), st.floats(-1, 1))
def test_best_segmentation_against_all_segmentations(n, items, trans, own):
    items = [(a, min(n, a + k), kind, round(s, 3)) for a, k, kind, s in items if a < n]
    t = dict(zip([(p, q) for p in personal.STATES for q in personal.STATES], trans))
    weights = {"O|x": own} | {f"{k}|f{i}": s for i, (_, _, k, s) in enumerate(items)}
    spans = [(a, e, k, [f"f{i}"]) for i, (a, e, k, _) in enumerate(items)]
    toks = [(i, i + 1, "x") for i in range(n)]

    def value(pick):
        at, last, total = 0, "O", 0.0
        for i in sorted(pick, key=lambda i: items[i][0]):
            a, e, k, s = items[i]
            if a < at:
                return None
            for _ in range(at, a):
                total, last = total + t[last, "O"] + own, "O"
            total, last, at = total + t[last, k] + s, k, e
        for _ in range(at, n):
            total, last = total + t[last, "O"] + own, "O"
        return total

    best = max(v for m in range(2 ** len(items)) if (v := value([i for i in range(len(items)) if m >> i & 1])) is not None)
    got = personal.best_segmentation(toks, [(a, e, i) for i, (a, e, _, _) in enumerate(items)], spans, weights, t, ["x"] * n)
    assert abs(value(got) - best) < 1e-6


@pytest.mark.parametrize(
    "text,want",
    [
        ("please call Maria Kowalczyk today", [("Maria Kowalczyk", "name")]),
        ("signed off by John Nguyen.", [("John Nguyen", "name")]),
        ("Fatima Al-Sayed or Wei Zhang", [("Fatima Al-Sayed", "name"), ("Wei Zhang", "name")]),
        ("Thanks to Søren Kjeldsen and Aoife O'Connor.", [("Søren Kjeldsen", "name"), ("Aoife O'Connor", "name")]),
        ("The White House, 1600 Pennsylvania Avenue NW, Washington, DC 20500", [("1600 Pennsylvania Avenue NW, Washington, DC 20500", "address")]),
        ("Sede: Via Roma 12, 00184 Roma", [("Via Roma 12, 00184 Roma", "address")]),
        ("10 Downing Street, London SW1A 2AA", [("10 Downing Street, London SW1A 2AA", "address")]),
        ("We visited New York and San Francisco.", []),
    ],
)
def test_unseen_names_and_other_countries(text, want):
    """None of these names is in the table of names or in the lines the model was fitted on."""
    assert spans(text) == want


def test_share_of_unseen_names_found():
    given, family = "Giulia Hiroshi Katarzyna Olumide Ingeborg Mateusz Sunniva Rajesh".split(), "Ferraro Tanaka Zielinska Adeyemi Thorvaldsen Banerjee Halvorsen Castellano".split()
    around = ["Please call {} today.", "The letter from {} arrived.", "Written by {}", "Ask for Mrs {} at the desk.", "We thank {} for the help."]
    cases = [(a.format(f"{g} {f}"), f"{g} {f}") for a in around for g in given for f in family]
    assert sum(spans(t) == [(n, "name")] for t, n in cases) >= 0.9 * len(cases)


class Counted:
    """A pattern that counts how often it is asked."""

    def __init__(self, pattern):
        self.pattern, self.asked = pattern, {}

    def __getattr__(self, name):
        self.asked[name] = self.asked.get(name, 0) + 1
        return getattr(self.pattern, name)


def test_words_beside_spans_are_read_once_for_each_start_and_end(monkeypatch):
    side = Counted(personal._SIDE)
    monkeypatch.setattr(personal, "_SIDE", side)
    _, found = personal.spans_of("Near Grace May Fenmartsen Ganliver Korkomsen: Flat 3, 84 Rasmere Lane, Torhaven QV17 7ZZ here", NAMES)
    assert {k for _, _, k, _ in found} == {"name", "address"} and len(found) > 30
    assert side.asked["findall"] == len({(k, a) for a, _, k, _ in found}) and side.asked["search"] == len({(k, e) for _, e, k, _ in found})


@pytest.mark.parametrize("line,n", [("In 2024 we sold 120 pipes to 35 mills, 7 of them in March.", 0), ("Call 01632 960 563 after six.", 1), ("A 1-2 b 3/45.6 now", 1)])
def test_only_lines_with_six_digits_are_searched_for_numbers(monkeypatch, line, n):
    run = Counted(personal._NUMBER_RUN)
    monkeypatch.setattr(personal, "_NUMBER_RUN", run)
    personal.spans_of(line, NAMES)
    assert run.asked.get("finditer", 0) == n


PIECES = ["O'Brien", "d’Arc", "J", "Grace", "van", "de la", "l'", " ", "  ", ", ", "-", ".", "- ", "/", "+", "(", ")", "@", "º", "nº", "1", "12", "123456", "٣", "ж", "Ж", "Āb", "_", "x", "ab", "abc", "SW1A", "12ab", "’", "Rd", "rue", "文"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_fast_patterns_find_what_plain_ones_find(t):
    """Runs as their definitions say them, letter by letter and asked at every place."""
    up, low, small = personal._UP, personal._LOW, personal._SMALL
    cap = f"[{up}](?:[{up}{low}]|['’](?=[{up}{low}]))*"
    name = rf"(?<![\w'’@]){cap}(?:(?:\.? {{1,3}}|\. ?|-|, {{1,2}}|\.-)(?:(?:{small}) {{1,2}}){{0,3}}(?:[dl]['’])?{cap})+"
    address = (
        rf"(?<![\w'’@])(?:{cap}|\d{{1,5}}[A-Za-z]?(?!\w))(?:(?:[.]?,? {{1,3}}| - |[-/]|\.º ?|º ?|\. ?)(?:(?:{personal._LOWWAYS}|{small}|dell|bis|n|nº) ?[.'’]?º? ?){{0,3}}"
        rf"(?:{cap}\d{{0,2}}(?:(?<=\d)[A-Z])?(?!\w)|\d{{1,5}}(?:[A-Za-z]{{1,2}})?(?!\w)|[a-z](?!\w)))+"
    )
    for plain, fast in ((name, personal._NAME_RUN), (address, personal._ADDRESS_RUN)):
        assert [m.span() for m in re.finditer(plain, t)] == [m.span() for m in fast.finditer(t)]
    if any(len(re.findall(r"\d", m.group())) >= 6 for m in personal._NUMBER_RUN.finditer(t)):
        assert personal._SIX_DIGITS.search(t)


def test_personal_operator(spark):
    rows = [(1, "u", "t", "Mail a@b.example or Grace Fenmartsen."), (1, "u", "t", "Mail a@b.example or Grace Fenmartsen."), (2, None, None, None), (3, "u", "t", "")]
    names = spark.createDataFrame([("Grace", "given"), ("Fenmartsen", "family"), (None, "given"), ("x", None)], "name string, kind string")
    got = sorted((r.doc_id, r.kind, r.start_char, r.end_char) for r in personal.personal_spans(docs(spark, rows), names).collect())
    assert got[0] == (1, "email", 5, 16) and all(g[0] == 1 for g in got)
    text = {r.doc_id: r.text for r in personal.redacted(docs(spark, rows), names).collect()}
    assert text[1].startswith("Mail [EMAIL] or") and text[2] is None and text[3] == ""
    assert personal.personal_spans(docs(spark, rows).limit(0), names.limit(0)).count() == 0


def test_line_keys_drop_all_but_letters(spark):
    df = spark.createDataFrame([("© 2020 É! 日本",)], "x string")
    assert df.select(repeated_lines.line_key(F.col("x"))).first()[0] == "é日本" and re.fullmatch(r"\w+", residue.key_of("É 日本"))
