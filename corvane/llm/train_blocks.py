"""Fit the line tagger: python -m corvane.llm.train_blocks DOCUMENTS.parquet [OUT]

Labelled pages: at most PAGES documents, taken evenly by position. A line is no content where ``line_rules`` say so or where
pages of REPEATED documents of its site in the sample have it (pages that are hardly more than a message apart: there the
message is the content); and pages written here with lines of the general web. In a part of the lines that a step sees, words are left
out, so that form, place and neighbours learn to decide too. Maximum likelihood of a linear-chain conditional random field
(forward-backward), Adam, L2. Every fifth page is held out and scored; besides, a model is fitted without every page that
has one of the WITHHELD kinds of phrases and scored on the lines with these.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np

from corvane.llm.blocks import LEXICAL, MODEL, S, page_features, plain, viterbi
from corvane.llm.line_rules import PHRASES, label_lines

PAGES, LEAST, EPOCHS, BATCH, L2 = 6000, 3, 6, 32, 1e-6
#: Documents of a site in the sample from which on a line is labelled as repeated, and words a page must have for that.
REPEATED, PAGE_WORDS = 5, 60
#: Share of lines that a step sees without their words, and share of words dropped in the other lines.
WORDLESS, DROPPED = 0.15, 0.1
#: Lines up to which a page counts three times: pages that are only a message are few.
SHORT = 8
#: Numbers of the phrases withheld from the second fit.
WITHHELD = range(3, len(PHRASES), 7)

#: Lines of the general web that are no content, and paragraphs that are.
NO_CONTENT = """Skip to main content|Skip to content|Sign in|Register|My account|Basket (0)|Search this site|Subscribe to our newsletter|Follow us on social media|Privacy policy|Terms of service|Terms of service | Privacy policy | Cookies
Accept all cookies|We use cookies to improve your experience. Accept or manage your settings.|Copyright 2021 The Company Ltd. All rights reserved.|Powered by OpenSite|Share on Facebook|Tweet this|Print|Email this page|Posted in News
Leave a comment|3 replies|Read more|Continue reading|Load more articles|Older posts|Newer posts|Filed under: Gardening, Tools|Advertisement|Sponsored content|Sign up to our weekly email and never miss an article|Download our free app today
Home > Advice > Heating|Products - Support - Company - Careers|Language: English|Sitemap|Accessibility statement|Registered in England no. 0123456|Tel: 0100 555 0100 | info@company.example|Opening times: Monday to Friday 9 to 5|By John Smith, 4 May 2020|Published on 12 March 2019|5 min read|Was this page useful? Yes No""".replace("\n", "|||").replace(" | ", " ¦ ").replace("|||", "|").split("|")
CONTENT = """A boiler that loses pressure every few days usually has a leak somewhere in the system, and the first place to look is under each radiator valve.
When the weather turns cold, plants in pots should be moved close to the house, where the wall keeps some of the warmth of the day.
We tested eleven kettles over four weeks. The cheapest boiled a litre of water as quickly as the most expensive one, but it was much louder.
The museum was founded in 1887 by a group of teachers, who collected minerals and fossils on their walks and showed them in the town hall.
Mix the flour with the butter until it looks like crumbs, then add the egg and a little water, and leave the dough to rest for half an hour.
If your claim is refused, you can ask for the decision to be looked at again. You have one month to do this, and you should say why you disagree.
Trains to the coast leave every hour from platform two. At weekends there are two more in the morning, which do not stop at the smaller stations.
The study followed two thousand adults for ten years and found that those who slept less than six hours a night had more accidents at work.
Before you paint a ceiling, wash it with warm water and a little soap, fill the cracks, and let it dry for at least a day.
Our office was opened last year. Since then the team has grown to thirty people, most of whom live within a short walk of the river.
Dogs need a routine. Feed them at the same time every day, and go out with them before and after work, even when it rains.
The new law requires every landlord to have the gas pipes checked each year and to give the tenant a copy of the report within a month.
An old bicycle can be made safe again in an afternoon: replace the brake blocks, oil the chain, and check that no spoke is loose.
In the second half the visitors played better, but they had to wait until the last minute for the goal that they had deserved long before.
Interest is paid once a year. The rate depends on how much you save and on how long you leave the money in the account.
Why does bread go stale? The starch in it slowly gives up its water, which moves to the crust and from there into the air.
The path climbs through a wood of beech and oak, crosses two small bridges, and reaches the top after about an hour and a half.
Write down what you spend for a month. Most people are surprised how much goes on small things that they could easily do without.
Unlike paper, the new material does not tear when it is wet, so it can be used for bags that carry fruit and vegetables.
She learned to sail as a child, and at the age of twenty she crossed the ocean alone in a boat that she had built with her brother.""".split("\n")
HEADINGS = "How it works|Before you start|What you need|Questions and answers|A short history|The results|What to do next|Costs and benefits|Step by step|Our findings|Common mistakes|Why it matters".split("|")
NO_CONTENT = [x.replace(" ¦ ", " | ") for x in NO_CONTENT]


def shaken(text: str, r: random.Random) -> str:
    """A paragraph of the words of others in new order, so that no single word stands for content."""
    parts = text.split(". ")
    r.shuffle(parts)
    return ". ".join(p.rstrip(".") for p in parts) + "."


def written(n: int, seed: int):
    """(lines, title, labels) of pages of the general web."""
    r = random.Random(seed)
    for _ in range(n):
        title = r.choice(CONTENT).split(",")[0].split(".")[0][:60]
        head = r.sample(NO_CONTENT, r.randint(0, 4))
        foot = r.sample(NO_CONTENT, r.randint(0, 6))
        body = []
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.3:
                body.append(r.choice(HEADINGS))
            body.append(" ".join(shaken(r.choice(CONTENT), r) for _ in range(r.randint(1, 3))))
        if r.random() < 0.2:
            body.insert(r.randint(0, len(body)), "\x00" + r.choice(NO_CONTENT))
        lines = [(x, 1) for x in head] + ([(title, 0)] if r.random() < 0.8 else []) + [(x.lstrip("\x00"), int(x[0] == "\x00")) for x in body] + [(x, 1) for x in foot]
        yield [x for x, _ in lines], title if r.random() < 0.8 else "", [y for _, y in lines]


def _site(url) -> str:
    return re.sub(r"^www\.", "", re.sub(r"^[a-z][a-z0-9+.-]*://", "", str(url).strip().lower()).split("/")[0].split("?")[0].split(":")[0])


def examples(path: str, pages: int = PAGES):
    """(features by line, list marks, labels, numbers of withheld phrases in it) of each page."""
    import pandas as pd

    d = pd.read_parquet(path, columns=["url", "text", "title"])
    d = d.iloc[np.linspace(0, len(d) - 1, min(pages, len(d))).astype(int)]
    cache: dict = {}
    key = lambda x: re.sub(r"[\W\d_]+", "", x.lower())
    on = defaultdict(set)
    for k, (url, text) in enumerate(zip(d.url, d.text)):
        if isinstance(text, str) and len(text.split()) >= PAGE_WORDS:
            for x in set(map(key, text.split("\n"))):
                on[_site(url), x].add(k)
    held_out = [re.compile(PHRASES[i]) for i in WITHHELD]
    for url, text, title in zip(d.url, d.text, d.title):
        lines = (text or "").split("\n")
        at, feats, same = page_features(lines, title if isinstance(title, str) else "", cache)
        if at:
            y = label_lines(lines)
            wordy = len((text or "").split()) >= PAGE_WORDS
            y = [1 if v == 0 and wordy and key(x) and len(on[_site(url), key(x)]) >= REPEATED else v for x, v in zip(lines, y)]
            with_phrase = np.array([any(p.search(plain(lines[i])) for p in held_out) for i in at])
            yield feats, same, np.array([max(0, y[i]) for i in at]), with_phrase
    for lines, title, y in written(1200, 4):
        at, feats, same = page_features(lines, title, cache)
        yield feats, same, np.array([y[i] for i in at]), np.zeros(len(at), bool)


def fit(train, seed: int = 1):
    count = Counter(f for x, *_ in train for line in x for f in set(line))
    names = sorted(f for f, n in count.items() if n >= LEAST)
    index = {f: i for i, f in enumerate(names)}
    at = lambda line: np.array([index[f] for f in set(line) if f in index], int)
    lexical = np.array([f[0] == LEXICAL for f in names])
    data = [([at(line) for line in x], same, y) for x, same, y, *_ in train for _ in range(3 if len(x) <= SHORT else 1)]
    w, t, b = np.zeros((len(names), S)), np.zeros((2, S, S)), np.zeros(S)
    params = [w, t, b]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        for s in range(0, len(order), BATCH):
            g = [np.zeros_like(p) for p in params]
            for i in order[s : s + BATCH]:
                full, same, y = data[i]
                x = []
                for f_, r in zip(full, rng.random(len(full))):
                    word = lexical[f_]
                    x.append(f_[~word] if r < WORDLESS else f_[~word | (rng.random(len(f_)) > DROPPED)])
                e = np.stack([w[k].sum(0) for k in x])
                n = len(e)
                alpha = np.empty((n, S))
                beta = np.zeros((n, S))
                alpha[0] = b + e[0]
                for k in range(1, n):
                    z = alpha[k - 1][:, None] + t[same[k]]
                    top = z.max(0)
                    alpha[k] = top + np.log(np.exp(z - top).sum(0)) + e[k]
                for k in range(n - 2, -1, -1):
                    z = t[same[k + 1]] + (e[k + 1] + beta[k + 1])[None, :]
                    top = z.max(1)
                    beta[k] = top + np.log(np.exp(z - top[:, None]).sum(1))
                total = np.logaddexp.reduce(alpha[-1])
                p = np.exp(alpha + beta - total)
                d = p.copy()
                d[np.arange(n), y] -= 1
                for k in range(n):
                    g[0][x[k]] += d[k]
                    if k:
                        z = np.exp(alpha[k - 1][:, None] + t[same[k]] + (e[k] + beta[k])[None, :] - total)
                        g[1][same[k]] += z
                        g[1][same[k], y[k - 1], y[k]] -= 1
                g[2] += d[0]
            step += 1
            rate = 0.03 * (1 - epoch / EPOCHS)
            for j, p in enumerate(params):
                on = np.flatnonzero(g[j].reshape(len(p), -1).any(1))  # features of this batch only
                grad = g[j][on] / BATCH + L2 * p[on]
                m[j][on] = 0.9 * m[j][on] + 0.1 * grad
                v[j][on] = 0.999 * v[j][on] + 0.001 * grad * grad
                p[on] -= rate * (m[j][on] / (1 - 0.9**step)) / (np.sqrt(v[j][on] / (1 - 0.999**step)) + 1e-8)
    return names, w, t, b


def tagged(page, names, w, t, b):
    index = names
    e = np.stack([w[[index[f] for f in set(line) if f in index]].sum(0) for line in page[0]])
    return np.array(viterbi(e, page[1], t, b)) > 0


def main(path: str, out: str = MODEL) -> None:
    pages = list(examples(path))
    train, held = [p for i, p in enumerate(pages) if i % 5], pages[::5]
    names, w, t, b = fit(train)
    index = {f: i for i, f in enumerate(names)}
    hit = wrong = missed = 0
    for page in held:
        s, y = tagged(page, index, w, t, b), page[2] > 0
        hit, wrong, missed = hit + (s & y).sum(), wrong + (s & ~y).sum(), missed + (~s & y).sum()
    print(f"held out {len(held)} pages: precision {hit / (hit + wrong):.4f}, recall {hit / (hit + missed):.4f}", flush=True)
    keep = [i for i in range(len(names)) if np.abs(w[i] - w[i].mean()).max() > 0.05]
    with open(out, "w") as f:
        json.dump({"emission": {names[i]: [round(float(x), 3) for x in w[i] - w[i].mean()] for i in keep}, "transition": t.round(3).tolist(), "start": b.round(3).tolist()}, f, ensure_ascii=False, separators=(",", ":"))
    print(len(keep), "features", flush=True)
    if len(sys.argv) > 3:
        names, w, t, b = fit([p for p in train if not p[3].any()])
        index = {f: i for i, f in enumerate(names)}
        found = [tagged(page, index, w, t, b)[page[3]] for page in held if page[3].any()]
        print(f"lines with withheld phrases: {np.concatenate(found).mean():.4f} of {sum(map(len, found))} found, fitted on {sum(not p[3].any() for p in train)} pages")


if __name__ == "__main__":
    main(*sys.argv[1:3])
