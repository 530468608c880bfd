"""Operator 5: main text of web pages by a recurrent labeller of their blocks."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages from which the labeller learns; a bound on the model's input only, every page is read whole and labelled.
TRAINING_PAGES = 300
#: Characters up to which a page teaches, and blocks of a page that do, a quarter of them from its end.
LONGEST, TAUGHT = 100_000, 80
#: Pages of other makes that it learns from besides.
LAYOUTS = 1500
PATH_DIMS, WORD_DIMS, NUMBERS = 96, 16, 4
HIDDEN = 32

# -- blocks ------------------------------------------------------------------------------------------------------

BREAKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whose content is no text, up to their own end tag.
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
#: Of these, the ones that end at the next break at the latest if their end tag is missing; a select ends there in any case.
SOFT = frozenset("noscript template svg iframe object select".split())
#: What an open element of a kind is closed by.
CLOSED_BY = {
    "p": BREAKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]),
}
CLOSERS = frozenset().union(*CLOSED_BY.values())
#: Above these an element that lacks its end tag isn't closed by another.
WALLS = ("table", "ul", "ol", "div", "article", "section", "body")
#: The kinds of elements that a tag closes.
CLOSES = {tag: tuple(kind for kind, closers in CLOSED_BY.items() if tag in closers) for tag in CLOSERS}
# Quotes count after = only. No part gives back what it has taken, so that a page is read in one pass.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?][^>]*>", re.S)
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*>", re.S)
OPENED = re.compile(r"<(?=[!?a-zA-Z]|/[a-zA-Z])")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
BREAK = re.compile(rf"</?(?:{'|'.join(sorted(BREAKS - {'option', 'select', 'hr'}))})(?=[\s/>])", re.I)


class Place:
    """An element with what it says of itself, the place it stands in, and the label of the closest marked element."""

    __slots__ = ("above", "tag", "said", "label")

    def __init__(self, above: Place | None, tag: str, said: str):
        self.above, self.tag, self.said = above, tag, said
        self.label = "data-main=1" in said if "data-main=" in said else above.label if above else None


class Block:
    """A run of text between breaks: its text, the innermost of the elements above it, the characters in links, the label if marked."""

    __slots__ = ("text", "place", "linked", "label")

    def __init__(self, text: str, place: Place | None, linked: int):
        self.text, self.place, self.linked, self.label = text, place, linked, place.label if place else None

    @property
    def path(self) -> list[tuple[str, str]]:
        """The elements above the text, the outermost first."""
        out, place = [], self.place
        while place:
            out.append((place.tag, place.said))
            place = place.above
        return out[::-1]


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in its order. Tags that aren't closed, or are closed twice, end where browsers end them.

    Blocks share their places, and an inline element that says nothing has none of its own, so that elements that are never
    closed cost each block nothing.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place | None]] = []
    opened: defaultdict[str, list[int]] = defaultdict(list)  # where the stack holds a tag
    held: list[tuple[str, bool]] = []
    end = 0

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", unescape("".join(t for t, _ in held))).strip()
            if text:
                out.append(Block(text, stack[-1][1] if stack else None, sum(len(t) for t, link in held if link)))
            held.clear()

    def linked() -> bool:
        return bool(opened["a"])

    def last(tags: tuple[str, ...]) -> int:
        return max((opened[tag][-1] for tag in tags if opened[tag]), default=-1)

    def leave(k: int) -> None:
        for tag, _ in stack[k:]:
            opened[tag].pop()
        del stack[k:]

    ahead: dict[str, tuple[int, int]] = {}

    def coming(name: str, pattern: re.Pattern, at: int) -> tuple[int, int]:
        """Where the next match starts and ends, else the end of the page; it is looked for anew only when it is passed."""
        if name not in ahead or ahead[name][0] < at:
            found = pattern.search(page, at)
            ahead[name] = found.span() if found else (len(page), len(page))
        return ahead[name]

    at, final, tags = 0, page.rfind(">") + 1, TAG
    while (here := OPENED.search(page, at, final)) is not None:
        m = tags.match(page, here.start())
        if m is None:  # a quote that nothing ends: from here on tags end at the next >
            tags = PLAIN
            m = tags.match(page, here.start())
        if m is None:
            at = here.end()
            continue
        if m.start() > end:
            held.append((page[end : m.start()], linked()))
        at = end = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                if tag in BREAKS:
                    flush()
                leave(opened[tag][-1])
            elif tag in BREAKS:
                flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                start, close = coming(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I), at)
                block = coming("", BREAK, at)[0] if tag in SOFT and (start == len(page) or tag == "select") else close
                at = end = min(block, close)
            if tag in BREAKS:
                flush()
            continue
        if tag == "br":
            held.append((" ", False))
            continue
        if tag in BREAKS:
            flush()
        if tag in CLOSERS and (k := last(CLOSES[tag])) > last(WALLS):
            leave(k)
        if tag not in VOID and not m[3].endswith("/"):
            opened[tag].append(len(stack))
            said = " ".join(f"{a[0].lower()}={a[1] or a[2] or a[3]}" for a in ATTRIBUTE.findall(m[3])) if "=" in m[3] else ""
            above = stack[-1][1] if stack else None
            stack.append((tag, Place(above, tag, said) if said or tag in BREAKS else above))
    if end < len(page):
        held.append((page[end:], linked()))
    flush()
    return out


# -- features ----------------------------------------------------------------------------------------------------

_SIGNS = np.random.default_rng(3).normal(size=(4096, WORD_DIMS)).astype(np.float32) / 4


def _hashed(v: np.ndarray, *tokens: str) -> np.ndarray:
    """v with each token added in two places, so that two tokens rarely share all of theirs."""
    for token in tokens:
        h = crc32(token.encode())
        for k in (0, 12):
            v[(h >> k) % PATH_DIMS] += 1.0 if (h >> 24 + k // 12) & 1 else -1.0
    return v


class Features:
    """Vectors of blocks: hashed tag path, mean of hashed words, and four numbers."""

    def __init__(self):
        self.places: dict[tuple[int, str, str], int] = {}  # the number of a path by that of the path above it
        self.sums: list[np.ndarray] = []
        self.paths: dict[int, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _forget(self) -> None:
        self.places.clear()
        self.paths.clear()
        self.sums[:] = [np.zeros(PATH_DIMS, np.float32)]

    def _number(self, place: Place | None, numbers: dict[Place | None, int]) -> int:
        """The number of a path; sums has the vectors of its elements added up, so that each is looked at once."""
        down = []
        while place not in numbers:
            down.append(place)
            place = place.above
        number = numbers[place]
        for place in reversed(down):
            own = (number, place.tag, place.said)
            if (known := self.places.get(own)) is None:
                said = re.sub(r"data-main=\S*|\b(class|id|role|itemprop)=", " ", place.said)
                names = [n for n in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", said).lower()) if n]
                self.places[own] = known = len(self.sums)
                self.sums.append(_hashed(self.sums[number].copy(), f"<{place.tag}>", *(f".{n}" for n in names)))
            numbers[place] = number = known
        return number

    def path(self, place: Place | None, numbers: dict[Place | None, int]) -> np.ndarray:
        number = self._number(place, numbers)
        if (v := self.paths.get(number)) is None:
            v = self.sums[number].copy()
            self.paths[number] = v = np.clip(_hashed(v, f"leaf {place.tag}") if place else v, -2, 2)
        return v

    def _word(self, word: str) -> int:
        if len(self.words) > 500_000:
            self.words.clear()
        self.words[word] = h = crc32(word.encode("utf-8", "replace")) % 4096
        return h

    def of(self, blocks: list[Block]) -> np.ndarray:
        n = len(blocks)
        x = np.empty((n, PATH_DIMS + WORD_DIMS + NUMBERS), np.float32)
        get, ids, ends = self.words.get, [], []
        if not self.sums or len(self.sums) > 50_000:
            self._forget()
        numbers: dict[Place | None, int] = {None: 0}
        for k, b in enumerate(blocks):
            x[k, :PATH_DIMS] = self.path(b.place, numbers)
            for w in b.text.split(" "):
                ids.append(h if (h := get(w)) is not None else self._word(w))
            ends.append(len(ids))
            x[k, -NUMBERS:] = (np.log1p(len(b.text)) / 4, min(1.0, b.linked / len(b.text)), k / n, np.log1p(n) / 4)
        if n:
            starts = np.array([0, *ends[:-1]])
            x[:, PATH_DIMS:-NUMBERS] = np.add.reduceat(_SIGNS[np.array(ids)], starts, axis=0) / np.diff(starts, append=ends[-1])[:, None]
        return x


# -- the bidirectional LSTM --------------------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _run(x: np.ndarray, w: dict[str, np.ndarray], keep: bool = False):
    """Hidden states (batch, time, HIDDEN) of one direction; with keep, what the way back needs."""
    b, t, _ = x.shape
    z = x @ w["x"] + w["b"]
    h, c = np.zeros((b, HIDDEN), x.dtype), np.zeros((b, HIDDEN), x.dtype)
    out, states = np.empty((b, t, HIDDEN), x.dtype), []
    for k in range(t):
        g = z[:, k] + h @ w["h"]
        i, f, o = np.split(_sigmoid(g[:, : 3 * HIDDEN]), 3, axis=1)
        u = np.tanh(g[:, 3 * HIDDEN :])
        before, c0 = h, c
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[:, k] = h
        if keep:
            states.append((i, f, o, u, tc, c0, before))
    return (out, states) if keep else out


def _back(x: np.ndarray, w: dict[str, np.ndarray], states: list, dout: np.ndarray) -> dict[str, np.ndarray]:
    b, t, _ = x.shape
    dz = np.empty((b, t, 4 * HIDDEN), x.dtype)
    dh, dc, dwh = np.zeros((b, HIDDEN), x.dtype), np.zeros((b, HIDDEN), x.dtype), np.zeros_like(w["h"])
    for k in range(t - 1, -1, -1):
        i, f, o, u, tc, c0, before = states[k]
        dh = dh + dout[:, k]
        dc = dc + dh * o * (1 - tc**2)
        g = np.concatenate((dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)), axis=1)
        dz[:, k] = g
        dwh += before.T @ g
        dh, dc = g @ w["h"].T, dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return {"x": x.reshape(-1, x.shape[2]).T @ flat, "h": dwh, "b": flat.sum(0)}


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(batch, mask, each page's places from its end to its start, the padding staying behind)."""
    n = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), n.max(), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    at = np.arange(n.max())
    return x, at < n[:, None], np.where(at < n[:, None], n[:, None] - 1 - at, at)


def scores(pages: list[np.ndarray], model: dict) -> list[np.ndarray]:
    """The probability of each block of each page, pages of like lengths together; any length is read whole."""
    out: list = [np.empty(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        now, order = order[-max(1, min(256, 40_000 // longest)) :], order[: -max(1, min(256, 40_000 // longest))]
        x, _, turn = _padded([pages[k] for k in now])
        fore = _run(x, model["fore"])
        back = np.take_along_axis(_run(np.take_along_axis(x, turn[:, :, None], 1), model["back"]), turn[:, :, None], 1)
        p = _sigmoid(np.concatenate((fore, back), axis=2) @ model["out"] + model["bias"])
        for row, k in enumerate(now):
            out[k] = p[row, : len(pages[k])]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.01, seed: int = 5) -> dict:
    """A labeller from (features, labels) of pages, by Adam on the mean cross entropy of blocks."""
    rng = np.random.default_rng(seed)
    d = PATH_DIMS + WORD_DIMS + NUMBERS
    one = lambda: {"x": rng.normal(0, d**-0.5, (d, 4 * HIDDEN)).astype(np.float32), "h": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32), "b": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}
    model = {"fore": one(), "back": one(), "out": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "bias": np.zeros((), np.float32)}
    slots = [(model[a], b) for a in ("fore", "back") for b in "xhb"] + [(model, "out"), (model, "bias")]
    m, v, step = [0.0] * len(slots), [0.0] * len(slots), 0
    pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
    batches = [pages[k : k + 24] for k in range(0, len(pages), 24)]
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            x, mask, turn = _padded([p for p, _ in batches[b]])
            y = _padded([q[:, None].astype(np.float32) for _, q in batches[b]])[0][:, :, 0]
            xb = np.take_along_axis(x, turn[:, :, None], 1)
            fore, s1 = _run(x, model["fore"], True)
            back, s2 = _run(xb, model["back"], True)
            both = np.concatenate((fore, np.take_along_axis(back, turn[:, :, None], 1)), axis=2)
            dz = ((_sigmoid(both @ model["out"] + model["bias"]) - y) * mask / mask.sum()).astype(np.float32)
            dboth = dz[:, :, None] * model["out"]
            g1 = _back(x, model["fore"], s1, dboth[:, :, :HIDDEN])
            g2 = _back(xb, model["back"], s2, np.take_along_axis(dboth[:, :, HIDDEN:], turn[:, :, None], 1))
            grads = [g1[k] for k in "xhb"] + [g2[k] for k in "xhb"] + [(both * dz[:, :, None]).sum((0, 1)), dz.sum()]
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            step += 1
            for k, ((where, name), g) in enumerate(zip(slots, grads)):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                now = rate * (0.3 if epoch > epochs * 0.6 else 1.0)
                where[name] = (where[name] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


# -- what it learns from -----------------------------------------------------------------------------------------

# What elements of pages are called.
MAIN = "article content main story entry post body text page article-body post-content entry-content main-content story-body".split()
ASIDE = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu site-nav links pager pagination".split(),
    "header": "header masthead banner top site-header page-header logo branding tagline".split(),
    "footer": "footer bottom site-footer copyright legal colophon page-footer imprint".split(),
    "sidebar": "sidebar aside widget related rail side-column recommended popular trending tags more-stories".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert newsletter paywall popup overlay message subscribe".split(),
    "advert": "ad ads advert advertisement sponsored promo banner-ad adsense sponsor promoted ad-slot".split(),
    "form": "form search search-form login signup contact-form subscribe-form".split(),
    "comments": "comments comment reader-comments comment-list responses discussion disqus replies user-comments feedback".split(),
    "share": "share social share-buttons social-links follow byline-links".split(),
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section", "notice": "div"}


def _taught(page: str) -> list[tuple[Block, bool]]:
    """Blocks of a page with labels by its markup: inside article or main, but not inside what is set apart there."""
    out = []
    apart = {"nav", "header", "footer", "aside", "form", "button", "fieldset", "dialog", "menu"}
    names = {n for group in ASIDE.values() for n in group}
    for b in blocks_of(page):
        inside = False
        for tag, said in b.path:
            words = {w for x in re.findall(r"=(\S+(?: \S+)*?)(?= \w+=|$)", said) for w in x.lower().split()}
            if tag in ("article", "main"):
                inside = True
            elif tag in apart or words & names:
                inside = False
        out.append((b, inside))
    return out


def _layout(pool: list[str], rng: random.Random) -> str:
    """A page of another make: the pool's texts as an article among menus, notices, comments and so on."""
    text = lambda: rng.choice(pool)
    short = lambda: " ".join(text().split()[: rng.randint(1, 6)])

    def element(tag: str, names: list[str], inner: str, main: int | None = None) -> str:
        said = f' class="{rng.choice(names)}"' if names and rng.random() < 0.7 else f' id="{rng.choice(names)}"' if names else ""
        return f"<{tag}{said}{'' if main is None else f' data-main={main}'}>{inner}</{tag}>"

    def paragraphs(n: int) -> str:
        made = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.72:
                t = text()
                t = t if rng.random() < 0.8 else " ".join(t.split()[: rng.randint(1, 8)])
                if rng.random() < 0.15:
                    w = t.split()
                    k = rng.randrange(len(w) + 1)
                    t = " ".join(w[:k]) + f' <a href="/x">{short()}</a> ' + " ".join(w[k:])
                made.append(f"<p>{t}</p>" if rng.random() < 0.85 else f"<p><b>{t}<br>")
            elif kind < 0.8:
                made.append(f"<h{rng.randint(2, 4)}>{short()}</h2>")
            elif kind < 0.87:
                made.append("<ul>" + "".join(f"<li>{short() if rng.random() < 0.6 else text()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                made.append(f"<blockquote>{text()}</blockquote>")
            elif kind < 0.96:
                made.append("<table>" + "".join(f"<tr><td>{short()}</td><td>{short()}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            else:
                made.append(f"<div>{text()}</div>" if rng.random() < 0.6 else f"<figure><figcaption>{short()}</figcaption></figure>")
        return "".join(made)

    def apart(kind: str) -> str:
        if kind == "menu":
            inner = "<ul>" + "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(rng.randint(2, 9))) + "</ul>"
        elif kind == "comments":
            inner = (f"<h3>{short()}</h3>" if rng.random() < 0.6 else "") + "".join(
                rng.choice(("<p>{}</p>", '<div class="comment"><p>{}</p></div>', "<li><b>" + short() + "</b><p>{}</p></li>", '<article class="comment">{}</article>')).format(
                    text() if rng.random() < 0.6 else short()
                )
                for _ in range(rng.randint(1, 6))
            )
        elif kind == "footer":
            inner = rng.choice(("&copy; {} &middot; {}", "<p>{}</p><p>{}</p>", '<a href="/">{}</a> <a href="/">{}</a>')).format(short(), text())
        elif kind == "form":
            inner = f"<label>{short()}</label><input name=q><button>{short()}</button>"
        elif kind == "sidebar":
            inner = f"<h3>{short()}</h3>" + "".join(rng.choice((f'<li><a href="/">{short()}</a></li>', f"<p>{text()}</p>")) for _ in range(rng.randint(1, 5)))
        else:
            inner = rng.choice((f"<p>{text()}</p>", text(), short(), f"<span>{short()}</span> <a href='/'>{short()}</a>"))
        tag = SEMANTIC.get(kind, "div") if rng.random() < 0.6 else "div"
        named = rng.random() < 0.6 or tag == "div" or tag == "section"
        return element(tag, ASIDE[kind] if named else [], inner, 0)

    kinds = list(ASIDE)
    before = [apart(k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "share", "sidebar"], rng.randint(1, 4))]
    after = [apart(k) for k in rng.sample(["footer", "comments", "sidebar", "share", "advert", "menu", "notice", "form"], rng.randint(1, 5))]
    parts = [paragraphs(rng.randint(1, 5))]
    for _ in range(rng.choice((0, 1, 1, 2, 3))):
        parts += [apart(rng.choice([k for k in kinds if k not in ("header", "footer", "menu")])), paragraphs(rng.randint(1, 4))]
    head = rng.choice((f"<h1>{short()}</h1>", f"<header><h1>{short()}</h1></header>", ""))
    inner = head + "".join(parts) + (apart(rng.choice(("comments", "share", "form", "sidebar"))) if rng.random() < 0.25 else "")
    tag = rng.choice(("article", "main", "div", "div", "section", "td"))
    main = element(tag, MAIN if tag in ("div", "section", "td") or rng.random() < 0.4 else [], inner, 1)
    if tag == "td":
        main = f"<table><tr>{main}</tr></table>"
    for _ in range(rng.choice((0, 0, 1, 2))):
        main = element("div", ["wrapper", "container", "layout", "site", "page"], main)
    return "<html><body>" + "".join(before) + main + "".join(after) + "</body></html>"


def learn(pages: list[str], seed: int = 13, blocks: int = TAUGHT) -> dict:
    """A labeller from a bounded sample of pages: their own markup teaches it, and LAYOUTS pages of other makes.

    Of each page `blocks` blocks teach, the last quarter of them from its end.
    """
    rng, features = random.Random(seed), Features()
    taught = [_taught(p) for p in pages]
    pool = sorted({b.text.replace("<", "&lt;") for page in taught for b, main in page if main and len(b.text) > 30}) or ["A text of a few words that says nothing in particular."]
    examples = []
    for page in taught:
        page = page[: blocks - blocks // 4] + page[len(page) - blocks // 4 :] if len(page) > blocks else page
        if any(main for _, main in page):
            examples.append((features.of([b for b, _ in page]), np.array([main for _, main in page])))
    for _ in range(LAYOUTS):
        made = blocks_of(_layout(pool, rng))
        examples.append((features.of(made), np.array([bool(b.label) for b in made])))
    return train(examples)


def main_text(pages: DataFrame, *, sample: int = TRAINING_PAGES, longest: int = LONGEST, blocks: int = TAUGHT) -> DataFrame:
    """page_id, url, text and n_chars of every page: the blocks labelled as main text, joined by line ends.

    The labeller is learnt once from at most `sample` pages of at most `longest` characters, those with the smallest hashes
    of their ids, and from `blocks` blocks of each: these three bound what it learns from only. Each page is then read whole. A null, empty or blank html gives an empty text; a block is never cut or dropped for its length; repeated
    rows are read each; pages of one text give it again; only page_id, url and html are read. An empty table gives no rows.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rank = F.xxhash64("page_id", "url")
    fit = p.where(F.length("html").between(1, longest))
    # The bound is found on hashes alone, so that no task sends pages that aren't in the sample.
    bound = fit.select(rank.alias("rank")).orderBy("rank").limit(sample).agg(F.max("rank")).first()[0]
    few = fit.where(rank <= F.lit(bound)).orderBy(rank, "page_id").limit(sample).select("html").collect()
    model = learn([r[0] for r in few], blocks=blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                blocks = [blocks_of(h) for h in part.column(2).to_pylist()]
                labels = scores([features.of(b) for b in blocks], model)
                texts = ["\n".join(b.text for b, s in zip(page, label) if s >= 0.5) for page, label in zip(blocks, labels)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")
