"""Fit the random field of personal data: python -m corvane.llm.train_personal DOCUMENTS PERSON_NAMES [OUT]

Labelled lines: those of at most DOCS documents, taken evenly by position, labelled by the rules of ``personal_rules``; copies
of lines in which the names are exchanged for names of many countries, so that endings and known names do not decide alone,
or which are in capitals or small letters throughout; and lines written here with addresses, numbers and names of other countries, and with capitalised words that are nothing.
Conditional likelihood over all segmentations of a cluster (semi-Markov forward-backward), Adam, L2. Every fifth line is
held out and scored.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter

import numpy as np

from corvane.llm import personal_rules as rules
from corvane.llm.personal import KINDS, MODEL, STATES, Names, best_segmentation, clean, clusters, nothing, spans_of, transitions

DOCS, EPOCHS, BATCH, L2, LEAST = 6000, 6, 64, 1e-5, 2

#: Names that stand in for those of labelled lines.
GIVEN = """Anna Peter Laura Michael Susan James Emma Oliver Sarah David Linda Robert Karen Thomas Nancy Daniel Carlos Miguel Lucia Carmen Javier Jean Pierre Claire Antoine Mathieu Camille
Hans Jürgen Katrin Uwe Heike Giovanni Luca Francesca Marco Chiara Piotr Agnieszka Krzysztof Ivan Olga Dmitri Svetlana Mehmet Ayşe Emre Ahmed Hassan Layla Khalid Aisha Ravi Anjali Deepak Sunita Arjun
Ming Xiu Li Jun Hiroto Yuki Sakura Min-jun Ji-woo Thanh Linh Kofi Ama Chinedu Ngozi Tunde Lars Astrid Björn Sigrid Mikko Aino Seán Niamh Ewa Bogdan Ioana Zoltán Eszter Nikos Eleni João Beatriz Tiago""".split()
FAMILY = """Smith Johnson Brown Taylor Miller Davis Wilson Clark Lewis Walker Hall Young King Wright Scott Green Baker Adams Nelson Carter Mitchell Perez Roberts Turner Phillips Campbell Parker Evans Edwards Collins
García Rodríguez Martínez López Sánchez Fernández Gómez Díaz Ruiz Moreno Dubois Lefèvre Moreau Laurent Girard Roux Fontaine Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Koch Richter Rossi Russo Bianchi
Romano Colombo Ricci Marino Greco Nowak Wiśniewski Wójcik Kamiński Lewandowski Ivanov Petrov Smirnov Popov Sokolov Yılmaz Kaya Demir Çelik Khan Hussain Ali Rahman Patel Sharma Singh Gupta Kumar Reddy Iyer
Wang Chen Liu Yang Huang Zhao Wu Suzuki Sato Yamamoto Nakamura Kobayashi Kim Park Choi Tran Pham Le Mensah Owusu Okafor Okoye Eze Hansen Andersson Lindqvist Nieminen Virtanen O'Brien Murphy Kelly Popescu
Nagy Kovács Papadopoulos Silva Santos Oliveira Pereira Costa Jensen Larsen Bakker Visser Al-Farsi Haddad Mansour Cohen Levy Friedman Novák Dvořák Horvat Babić""".split()
#: Capitalised words that name no person.
OTHERS = """New York|San Francisco|Los Angeles|United Kingdom|North Sea|Royal Mail|River Thames|Science Museum|Red Cross|Grand Hotel|Hotel Bristol|Lake Geneva|Saint Petersburg|Customer Service|Privacy Policy|Terms Of Use|Annual Report
Monday Morning|Happy Easter|Google Maps|Microsoft Office|World Bank|European Union|Main Street|Park Avenue|Central Station|South Africa|Buenos Aires|Mount Everest|Summer Sale|Black Friday|Table Of Contents|Quick Start|User Guide
Ford Focus|Land Rover|Apple Store|Deutsche Bahn|Rio Grande|Cape Town|Hong Kong|Puerto Rico|Great Britain|Golden Gate|White House|High School|City Council|Health Service|Blue Ridge|Spring Fair|Union Square|West Bank|Free Delivery
Smith Brothers Ltd|Walker Press|Baker & Sons|Taylor Plumbing|Green Energy|King Hotel|Young Company|Hall Of Fame|Carter Works|Miller Guild""".replace("\n", "|").split("|")
CITIES = "Springfield Portland Austin Madison Denver Boston Chicago Houston Milano Torino Napoli Firenze Bologna Utrecht Leiden Leeds Bristol York Cardiff Lyon Nantes Lille Sevilla Bilbao Hamburg Bremen Dresden Salem Dayton Fresno Cleveland Pisa Verona Palermo Genova".split()
STREETS = "Maple Oak Lincoln Jefferson Washington Market Mill Church Park Victoria Garibaldi Mazzini Verdi Dante Cavour Manzoni Lafayette Station Hill Kings Highland Sunset Cedar Elm Franklin Molino Nazionale Republik Schiller Goethe".split()
WAYS_US = "Street St. Avenue Ave Road Rd Drive Dr Lane Boulevard Blvd Court Place Parkway".split()
STATES_US = "NY CA TX OH WA OR MA IL PA GA FL VA NC CO MI".split()
AROUND = ["{}", "Address: {}", "She lives at {}.", "Deliver to {} by noon.", "Our office at {} is open daily.", "Please send it to {}, thank you.", "Visit us: {}", "Registered office, {}.", "- {}", "He moved from {} last year.", "Sede: {}", "Indirizzo: {}", "Head office {} | 24 hours"]
NAME_AROUND = ["{}", "Please call {} today.", "Signed off by {}.", "{} or {}", "Dear {},", "{} wrote on Monday.", "We met {} and {}.", "Yours sincerely, {}", "Contact: {}", "Mr {} left.", "Dr. {} will see you now.", "- {}", "Author: {}", "according to {}, the owner", "a letter from {} arrived", "{} has joined the team as manager", "my colleague {} is away", "Ask {} about it.", "{}: please reply.", "By {}", "{} agreed at once.", "{} came back yesterday.", "{} said no.", "Our manager {} rang.", "Questions? Write to {} at once."]
OTHER_AROUND = ["{}", "We met at {} in spring.", "{} is closed today.", "A visit to {} costs $12.", "Contact {} for details.", "Read the {} before you start.", "in {}", "from {} to {}", "The {} opens at nine.", "{} - {}", "About {}", "by {} bus"]
NUMBERED = ["Room 12, Building C", "Chapter 3, Section 4", "Boeing 737, Airbus 320", "Monday 12 May 2019", "Model X 200, Series 5", "Version 2, Release 11 Beta", "Windows 11, Office 365", "Article 5, Annex 2 Part B", "Week 12, Spring 2021", "Page 10, Figure 3 Left", "Form 1040, Schedule C", "Gate 12, Terminal 2 North", "Between 10 May and 12 June 2020", "Psalm 23, Verse 4", "Euro 2024, Group A", "Track 7, Platform 9"]


def addresses(r: random.Random) -> str:
    c, s, n, z = r.choice(CITIES), r.choice(STREETS), r.randint(1, 2900), f"{r.randint(501, 99950):05d}"
    form = r.randrange(9)
    if form < 3:
        extra = r.choice(["", "", f", Apt {r.randint(1, 90)}", f", Suite {r.randint(100, 900)}", " NW", " SE", " N"])
        return f"{n} {r.choice(['', 'North ', 'W. ', ''])}{s} {r.choice(WAYS_US)}{extra}, {c}, {r.choice(STATES_US)} {z}"
    if form < 6:
        return f"{r.choice(['Via', 'Piazza', 'Viale', 'Corso', 'Largo', 'via'])} {r.choice(['', '', 'della ', 'Giuseppe ', 'San '])}{s}{r.choice([' ', ', '])}{n % 300 + 1}, {z} {c}"
    if form == 6:
        return f"{s}{r.choice(['straat', 'laan', 'straße', 'weg', 'str.', 'gasse'])} {n % 300 + 1}, {r.choice(['', '', 'D-']) + z if r.random() < 0.6 else z[:4] + ' ' + r.choice(['AB', 'KL', 'XZ'])} {c}"
    if form == 7:
        return f"{n % 200 + 1} {s} {r.choice(WAYS_US)}, {c} {r.choice(['LS', 'BS', 'YO', 'CF', 'SW', 'EC', 'N'])}{n % 20 + 1}{r.choice(['', '', 'A', 'W'])} {n % 9}{r.choice(['AB', 'XY', 'QD'])}"
    return f"{n % 200 + 1} {r.choice(['rue', 'avenue', 'place'])} {r.choice(['de la ', 'du ', ''])}{s}, {z} {c}"


def invented(r: random.Random) -> str:
    """A word of random syllables, so that no ending is needed for a name."""
    syllables = r.randint(2, 4)
    w = "".join(r.choice(["b", "br", "ch", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "sh", "st", "t", "th", "v", "w", "z", ""]) + r.choice("aeiou") for _ in range(syllables))
    return (w + r.choice(["", "", "n", "s", "l", "r", "k", "nd", "ng", "ski", "tti", "ren"])).capitalize()


def given_name(r: random.Random) -> str:
    return r.choice(GIVEN) if r.random() < 0.6 else invented(r)


def family_name(r: random.Random) -> str:
    return r.choice(FAMILY) if r.random() < 0.6 else invented(r)


def person(r: random.Random) -> str:
    g, f = given_name(r), family_name(r)
    form = r.randrange(12)
    if form == 0:
        return f"{g[0]}. {f}"
    if form == 1:
        return f"{g} {r.choice('ABCDEJKLMRST')}. {f}"
    if form == 2:
        return f"{f}, {g}"
    if form == 3:
        return f"{g} {r.choice(['van', 'de', 'von', 'de la', 'di', 'van der'])} {f}"
    if form == 4:
        return f"{g} {f}-{family_name(r)}"
    if form == 5:
        return f"{g} {given_name(r)} {f}"
    return f"{g} {f}"


def unrelated(r: random.Random) -> str:
    x = r.random()
    if x < 0.45:
        return r.choice(OTHERS)
    if x < 0.75:
        return f"{invented(r)} {r.choice(['Street', 'Valley', 'Hotel', 'Museum', 'Ltd', 'Station', 'Bridge', 'Festival', 'Road', 'Group', 'College', 'Bay', 'County', 'Press'])}" if r.random() < 0.7 else f"{r.choice(['Lake', 'Mount', 'Port', 'Saint', 'North', 'Hotel', 'Rio', 'Fort'])} {invented(r)}"
    return r.choice(NUMBERED)


def written(n: int, seed: int):
    """Lines of other countries with their spans: (line, [(start, end, kind)])."""
    r = random.Random(seed)
    for _ in range(n):
        x = r.random()
        kind, what, around = ("address", addresses, AROUND) if x < 0.3 else ("name", person, NAME_AROUND) if x < 0.7 else (None, unrelated, OTHER_AROUND)
        line, spans = "", []
        for k, piece in enumerate(r.choice(around).split("{}")):
            if k:
                w = what(r)
                if kind:
                    spans.append((len(line), len(line) + len(w), kind))
                line += w
            line += piece
        if r.random() < 0.3:
            other = r.choice(["The office is open. ", "Thank you. ", "We are glad to help: ", "Since 2019 "])
            line, spans = other + line, [(a + len(other), e + len(other), k) for a, e, k in spans]
        yield line, spans


def exchanged(line: str, spans: list, r: random.Random):
    """The line with other names in the same form."""
    out, at, moved = "", 0, []
    for a, e, k in sorted(spans):
        w = line[a:e]
        if k == "name":
            words = list(re.finditer(r"[^\W\d_]{2,}", w))
            big = [m for m in words if m.group()[0].isupper() or w.islower()]
            comma = "," in w
            for i, m in list(enumerate(big))[::-1]:
                family = i == 0 if comma else i == len(big) - 1
                new = family_name(r) if family else given_name(r)
                new = new.upper() if m.group().isupper() else new.lower() if m.group().islower() else new
                w = w[: m.start()] + new + w[m.end() :]
        out += line[at:a]
        moved.append((len(out), len(out) + len(w), k))
        out += w
        at = e
    return out + line[at:], moved


def labelled(docs: str, known: rules.Names):
    """Distinct lines of a bounded sample of documents with the spans the rules find."""
    import pandas as pd

    d = pd.read_parquet(docs, columns=["text"])
    d = d.iloc[np.linspace(0, len(d) - 1, min(DOCS, len(d))).astype(int)]
    seen = set()
    for text in d.text:
        t, _ = clean(text or "")
        cands = rules.candidates(t, known)
        gold = sorted((c[0], c[1], c[2]) for c, y in zip(cands, rules.label(t, cands)) if y)
        at = 0
        for line in t.split("\n"):
            end = at + len(line)
            if line not in seen and len(line) > 5:
                seen.add(line)
                yield line, [(a - at, e - at, k) for a, e, k in gold if at <= a and e <= end]
            at = end + 1


class Group:
    __slots__ = ("own", "segments", "path", "edges", "n", "gold")


def groups_of(line: str, spans: list, names: Names):
    """Clusters of a line as (features by token, segments with features, gold segments)."""
    t, found = spans_of(line, names)
    want = set(spans)
    for toks, segments in clusters(t, found):
        gold = sorted((s, e, i) for s, e, i in segments if (found[i][0], found[i][1], found[i][2]) in want)
        yield [nothing(w) for _, _, w in toks], [(s, e, found[i][2], [found[i][2], *(found[i][2] + "|" + f for f in found[i][3])]) for s, e, i in segments], {(s, e, found[i][2]) for s, e, i in gold}


def fit(data, index: dict[str, int], seed: int = 3) -> np.ndarray:
    """Adam on the negative log-likelihood of the gold segmentations."""
    S, state = len(STATES), {k: i for i, k in enumerate(STATES)}
    tr = np.array([[index[f"T|{p}|{q}"] for q in STATES] for p in STATES])
    packed = []
    for own, segs, gold in data:
        o = np.array([index.get("O|" + w, -1) for w in own])
        seg = [(s, e, state[k], np.array([index[f] for f in fs if f in index], int), (s, e, k) in gold) for s, e, k, fs in segs]
        path, at = [], 0
        for s, e, k, _, y in sorted(seg, key=lambda x: x[0]):
            if y:
                path += [(p, 0) for p in range(at + 1, s + 1)] + [(e, k)]
                at = e
        path += [(p, 0) for p in range(at + 1, len(own) + 1)]
        packed.append((len(own), o, seg, path))
    w = np.zeros(len(index))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(packed))
        for b in range(0, len(order), BATCH):
            g = np.zeros_like(w)
            trans = w[tr]
            for gi in order[b : b + BATCH]:
                n, o, seg, path = packed[gi]
                oscore = np.where(o >= 0, w[o], 0.0)
                sc = [w[x[3]].sum() for x in seg]
                ends: list[list[int]] = [[] for _ in range(n + 1)]
                for i, x in enumerate(seg):
                    ends[x[1]].append(i)
                alpha = np.full((n + 1, S), -np.inf)
                alpha[0, 0] = 0.0
                into = np.empty((n + 1, S))
                for p in range(n + 1):
                    if p:
                        alpha[p, 0] = into[p - 1, 0] + oscore[p - 1]
                        for i in ends[p]:
                            s, _, k, _, _ = seg[i]
                            alpha[p, k] = np.logaddexp(alpha[p, k], into[s, k] + sc[i])
                    z = alpha[p][:, None] + trans
                    top = z.max(0)
                    into[p] = top + np.log(np.exp(z - top).sum(0))
                beta = np.full((n + 1, S), -np.inf)
                beta[n] = 0.0
                back = np.full((n + 1, S), -np.inf)  # of a segment that starts at p with a state
                for p in range(n, -1, -1):
                    if p < n:
                        back[p, 0] = np.logaddexp(back[p, 0], oscore[p] + beta[p + 1, 0])
                        z = trans + back[p][None, :]
                        top = z.max(1)
                        beta[p] = top + np.log(np.exp(z - top[:, None]).sum(1))
                    for i in ends[p]:
                        s, _, k, _, _ = seg[i]
                        back[s, k] = np.logaddexp(back[s, k], sc[i] + beta[p, k])
                total = np.logaddexp.reduce(alpha[n])
                for p in range(n):
                    prob = np.exp(alpha[p][:, None] + trans + back[p][None, :] - total)
                    np.add.at(g, tr, prob)
                    if o[p] >= 0:
                        g[o[p]] += np.exp(into[p, 0] + oscore[p] + beta[p + 1, 0] - total)
                for i, (s, e, k, f, _) in enumerate(seg):
                    g[f] += np.exp(into[s, k] + sc[i] + beta[e, k] - total)
                last = (0, 0)
                for e, k in path:
                    g[tr[last[1], k]] -= 1
                    if k == 0:
                        if o[e - 1] >= 0:
                            g[o[e - 1]] -= 1
                    last = (e, k)
                for _, _, _, f, y in seg:
                    if y:
                        g[f] -= 1
            step += 1
            on = np.flatnonzero(g)  # features of this batch only: the penalty must not wear down rare ones
            grad = g[on] / BATCH + L2 * w[on]
            m[on] = 0.9 * m[on] + 0.1 * grad
            v[on] = 0.999 * v[on] + 0.001 * grad * grad
            w[on] -= 0.06 * (1 - epoch / EPOCHS) * (m[on] / (1 - 0.9**step)) / (np.sqrt(v[on] / (1 - 0.999**step)) + 1e-8)
    return w


def main(docs: str, person_names: str, out: str = MODEL) -> None:
    import pandas as pd

    n = pd.read_parquet(person_names)
    given, family = n[n.kind == "given"].name, n[n.kind == "family"].name
    names, known, r = Names(given, family), rules.Names(given, family), random.Random(5)
    lines = []
    for line, spans in labelled(docs, known):
        lines.append((line, spans))
        if any(k == "name" for _, _, k in spans) and r.random() < 0.6:
            lines.append(exchanged(line, spans, r))
        if spans and r.random() < 0.15:
            other = line.upper() if r.random() < 0.6 else line.lower()
            if len(other) == len(line):
                lines.append((other, spans))
    lines += written(16000, 6)
    data, count, missed = [], Counter(), Counter()
    for k, (line, spans) in enumerate(lines):
        got = set()
        for group in groups_of(line, spans, names):
            data.append((k % 5 == 0, group))
            count.update({f for _, _, _, fs in group[1] for f in fs})
            count.update({"O|" + w for w in group[0]})
            got |= {x[2] for x in group[2]}
        missed.update(k for k in {s[2] for s in spans} - got)
    print(len(lines), "lines,", len(data), "clusters; labels without a span:", dict(missed))
    index = {f: i for i, f in enumerate(sorted([f for f, k in count.items() if k >= LEAST] + [f"T|{p}|{q}" for p in STATES for q in STATES]))}
    w = fit([g for held, g in data if not held], index)
    weights = {k: round(float(w[i]), 3) for k, i in index.items() if abs(w[i]) >= 0.04}
    trans = transitions(weights)
    hit, wrong, lost = Counter(), Counter(), Counter()
    for own, segs, gold in (g for held, g in data if held):
        spans = [(s, e, k, [f.split("|", 1)[1] for f in fs[1:]]) for s, e, k, fs in segs]
        toks = [(0, 0, "") for _ in own]
        got = {spans[i][:3] for i in best_segmentation(toks, [(s, e, i) for i, (s, e, _, _) in enumerate(segs)], spans, weights, trans, own)}
        hit.update(x[2] for x in got & gold), wrong.update(x[2] for x in got - gold), lost.update(x[2] for x in gold - got)
    for k in KINDS:
        print(f"{k}: held out precision {hit[k] / max(1, hit[k] + wrong[k]):.4f}, recall {hit[k] / max(1, hit[k] + lost[k]):.4f} of {hit[k] + lost[k]}")
    with open(out, "w") as f:
        json.dump(weights, f, ensure_ascii=False, separators=(",", ":"))
    print(len(weights), "weights")


if __name__ == "__main__":
    main(*sys.argv[1:])
