"""HTML extraction by a bidirectional LSTM over a page's leaf blocks.

Each block is a vector of its tag path (hashed tags, classes and pairs of neighbours) and its
words (hashed), with its length and share of links. Two recurrences, from the first block
and from the last, carry the whole page's context to every block, which is then labelled as
main text or not. The model is trained on pages that are made up here: their layouts, class
names and words are drawn at random, and each block's label is known from the making.

Defined cases: a null or empty page, or one without main text, has an empty text and length
0; repeated rows are labelled each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackline.llm.html_blocks import Block, Path, blocks

TAG_SLOTS, WORD_SLOTS, EXTRA = 1024, 64, 4
HIDDEN = 16
#: Pages made up for training, and for measuring it.
TRAINING_PAGES, EPOCHS, SEED = 600, 12, 5
#: Pages that run through the recurrences together.
TOGETHER = 128
#: Starts main text in made-up pages; a private-use character.
MARK = "\ue000"
_SPLIT = re.compile(r"[\s_\-]+")


@lru_cache(maxsize=20_000)
def _bits(above: str | None, element: str) -> int:
    """Bits of the slots of an element's tag, its class words, and the pair it makes with the tag above."""
    tag, *classes = element.split(" ", 1)
    found = [f"tag {tag}", *([] if above is None else [f"pair {above} {tag}"]), *(f"class {w}" for c in classes for w in _SPLIT.split(c))]
    return functools.reduce(lambda bits, x: bits | 1 << zlib.crc32(x.encode()) % TAG_SLOTS, found, 0)


def path_slots(leaf: Path | None) -> int:
    """Bits of the slots of a path's tags, their class words and pairs of neighbours, and its leaf. What paths share is kept with it."""
    if leaf is None:
        return 0
    open_, at = [], leaf
    while at is not None and at.slots is None:
        open_.append(at)
        at = at.parent
    for at in reversed(open_):
        above = at.parent
        at.slots = _bits(above and above.element.split(" ", 1)[0], at.element) | (above.slots if above else 0)
    return leaf.slots | 1 << zlib.crc32(f"leaf {leaf.element.split(' ', 1)[0]}".encode()) % TAG_SLOTS


class _WordSlots(dict):
    """Slot of each word; kept up to a bound."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode()) % WORD_SLOTS
        if len(self) < 300_000:
            self[word] = value
        return value


_SLOTS = _WordSlots()


class Page:
    """A page's blocks as the network reads them: paths, and rows of hashed words and other figures."""

    def __init__(self, found: list[Block]):
        self.paths = [path_slots(b.leaf) for b in found]
        words = [b.text.split(" ") for b in found]
        counts = np.array([len(w) for w in words])
        slots = np.fromiter((_SLOTS[w] for ws in words for w in ws), np.int64, counts.sum())
        hashed = np.bincount(np.repeat(np.arange(len(found)), counts) * WORD_SLOTS + slots, minlength=len(found) * WORD_SLOTS).reshape(-1, WORD_SLOTS)
        sizes = np.array([len(b.text) for b in found])
        linked = np.array([b.linked for b in found])
        ends = np.array([b.text[-1] in ".!?" for b in found])
        other = np.stack([np.log1p(sizes) / 8, np.minimum(1, linked / sizes), ends, np.minimum(1, (counts - 1) / 50)], 1)
        self.dense = np.concatenate([hashed / counts[:, None], other], 1).astype(np.float32)

    def __len__(self) -> int:
        return len(self.paths)


class Batch:
    """Pages one after the other, and which places of the padded pages are live."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p) for p in pages])
        self.live = np.arange(sizes.max())[None] < sizes[:, None]
        self.dense = np.concatenate([p.dense for p in pages])
        numbers: dict[int, int] = {}
        self.path = np.array([numbers.setdefault(x, len(numbers)) for p in pages for x in p.paths])
        self.hot = np.zeros((len(numbers), TAG_SLOTS), np.float32)
        for x, k in numbers.items():
            self.hot[k] = np.unpackbits(np.frombuffer(x.to_bytes(TAG_SLOTS // 8, "little"), np.uint8), bitorder="little")


class Labeller:
    """Weights and both directions of the network, in numpy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h = TAG_SLOTS + WORD_SLOTS + EXTRA, HIDDEN
        init = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        self.w = {f"{k}{way}": v for way in "fb" for k, v in (("x", init(d, 4 * h)), ("h", init(h, 4 * h)), ("c", np.repeat(np.float32([0, 1, 0, 0]), h)))}
        self.w |= {"o": init(2 * h), "ob": np.zeros(1, np.float32)}

    def project(self, batch: Batch, way: str) -> np.ndarray:
        """Input parts of the gates, padded to (pages, blocks, gates)."""
        w, out = self.w[f"x{way}"], np.zeros((*batch.live.shape, 4 * HIDDEN), np.float32)
        out[batch.live] = (batch.hot @ w[:TAG_SLOTS])[batch.path] + batch.dense @ w[TAG_SLOTS:]
        return out

    def run(self, x: np.ndarray, live: np.ndarray, way: str, keep: bool = False):
        """Hidden states of one direction; live: which places hold a block."""
        n, steps, h = len(x), x.shape[1], HIDDEN
        state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, steps, h), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = x[:, t] + state @ self.w[f"h{way}"] + self.w[f"c{way}"]
            g = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o, a = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * a
            th, on = np.tanh(new), live[:, t, None]
            if keep:
                kept.append((t, state, cell, i, f, o, a, th, on))
            state, cell = np.where(on, o * th, state), np.where(on, new, cell)
            out[:, t] = state
        return out, kept

    def scores(self, pages: list[Page]) -> np.ndarray:
        batch = Batch(pages)
        both = np.concatenate([self.run(self.project(batch, way), batch.live, way)[0] for way in "fb"], 2)
        return both @ self.w["o"] + self.w["ob"]

    def label(self, found: list[list[Block]]) -> list[np.ndarray]:
        """For each page which blocks are main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(found)
        order = [i for i in sorted(range(len(found)), key=lambda i: len(found[i])) if found[i]]
        for k in range(0, len(order), TOGETHER):
            at = order[k : k + TOGETHER]
            for i, s in zip(at, self.scores([Page(found[i]) for i in at]), strict=True):
                out[i] = s[: len(found[i])] > 0
        return out

    def gradients(self, pages: list[Page], labels: list[list[bool]]) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean log loss of a few pages."""
        h, batch = HIDDEN, Batch(pages)
        live = batch.live
        truth = np.zeros(live.shape, np.float32)
        truth[live] = np.concatenate(labels)
        ran = {way: self.run(self.project(batch, way), live, way, True) for way in "fb"}
        both = np.concatenate([ran[way][0] for way in "fb"], 2)
        p = 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["ob"])))
        loss = -np.log(np.where(truth > 0, p, 1 - p) + 1e-7)[live].mean()
        ds = np.where(live, p - truth, 0) / live.sum()
        grad = {"o": np.einsum("nt,nth->h", ds, both), "ob": np.array([ds.sum()])}
        for k, way in enumerate("fb"):
            down = ds[:, :, None] * self.w["o"][k * h : (k + 1) * h]
            gx, gh = np.zeros((*live.shape, 4 * h), np.float32), np.zeros_like(self.w[f"h{way}"])
            dstate, dcell = np.zeros((len(pages), h), np.float32), np.zeros((len(pages), h), np.float32)
            for t, state, cell, i, f, o, a, th, on in reversed(ran[way][1]):
                ds_t = dstate + down[:, t]
                dc = dcell + ds_t * o * (1 - th * th)
                dz = np.concatenate([dc * a * i * (1 - i), dc * cell * f * (1 - f), ds_t * th * o * (1 - o), dc * i * (1 - a * a)], 1) * on
                gx[:, t] = dz
                gh += state.T @ dz
                dstate = np.where(on, dz @ self.w[f"h{way}"].T, ds_t)
                dcell = np.where(on, dc * f, dcell)
            flat = gx[live]
            by_path = np.zeros((len(batch.hot), 4 * h), np.float32)
            np.add.at(by_path, batch.path, flat)
            grad |= {f"x{way}": np.concatenate([batch.hot.T @ by_path, batch.dense.T @ flat]), f"h{way}": gh, f"c{way}": flat.sum(0)}
        return grad, float(loss)

    def fit(self, found: list[list[Block]], labels: list[list[bool]], epochs: int = EPOCHS, rate: float = 0.01, together: int = 16, seed: int = SEED) -> float:
        """Adam on small batches; the last loss."""
        rng, moment, step, loss = random.Random(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}, 0, 0.0
        pages = [Page(f) for f in found]
        order = list(range(len(pages)))
        for _ in range(epochs):
            rng.shuffle(order)
            for k in range(0, len(order), together):
                at = order[k : k + together]
                grad, loss = self.gradients([pages[i] for i in at], [labels[i] for i in at])
                step += 1
                for name, g in grad.items():
                    a, b = moment[name]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.w[name] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


_MAIN = (("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("section", "story"), ("div", "article-text"), ("article", "entry"), ("div", "main"))
_SIDE = {
    "nav": (("nav", ""), ("div", "nav"), ("ul", "menu"), ("div", "navbar top"), ("nav", "breadcrumb"), ("div", "toc")),
    "header": (("header", ""), ("div", "header"), ("div", "masthead"), ("div", "banner")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "site-info")),
    "aside": (("aside", ""), ("div", "sidebar"), ("div", "related"), ("aside", "widget"), ("div", "recommended")),
    "notice": (("div", "cookie notice"), ("div", "alert"), ("div", "consent"), ("p", "notice"), ("div", "popup modal")),
    "ad": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsored promo"), ("aside", "ad"), ("section", "advertisement")),
    "form": (("form", ""), ("form", "search"), ("form", "newsletter subscribe"), ("div", "login form")),
    "comments": (("div", "comments"), ("section", "comments"), ("section", "comment list"), ("div", "discussion replies"), ("ol", "commentlist")),
}


def made_page(rng: random.Random) -> str:
    """A page of a random layout, in which each block of main text starts with MARK."""
    syllables = [a + b + c for a in "bdfgklmnprstvw" for b in "aeiou" for c in ("", "n", "r", "st", "l")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def text(least: int, most: int, mark: bool) -> str:
        words = [word() for _ in range(max(1, min(most, int(rng.paretovariate(0.6) * least))))]
        said = " ".join(words) + rng.choice([".", ".", "", "!"])
        return MARK + said if mark else said

    def box(kind: tuple[str, str], inner: str) -> str:
        tag, name = kind
        how = rng.choice(["class", "class", "id"])
        return f"<{tag}{f' {how}="{name}"' if name else ''}>{inner}</{tag}>"

    def leaves(mark: bool, n: int) -> str:
        out = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.66:
                style = rng.random()
                said = text(3, 150, mark)
                formula = f" <math><mi>{word()}</mi><mo>=</mo><mn>{rng.randint(1, 99)}</mn></math> {word()}" if rng.random() < 0.06 else ""
                out.append(f"<p>{said}{formula}</p>" if style < 0.65 else f"<div>{said}</div>" if style < 0.7 else f"<p><b>{said}<br>" if style < 0.85 else f"<p>{said} <a href=x>{'' if mark else word()}</a></p>")
            elif kind < 0.76:
                out.append(f"<h{(k := rng.randint(2, 4))}>{text(1, 8, mark)}</h{k}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{text(2, 25, mark)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{text(3, 60, mark)}</blockquote>")
            elif kind < 0.91:
                out.append(f'<object data="{word()}"><p>{text(3, 30, mark)}</p></object>' if rng.random() < 0.5 else f"<svg><text>{text(1, 2, mark)}</text></svg>")
            elif kind < 0.92:
                out.append(f"<figure><img src=x><figcaption>{text(2, 12, mark)}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<pre>{text(3, 30, mark)}</pre>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{text(1, 4, mark)}</td><td>{text(1, 4, mark)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
        return "".join(out)

    def side(kind: str) -> str:
        if kind == "nav":
            inner = "".join(f'<li><a href="/{word()}">{text(1, 3, False)}</a></li>' for _ in range(rng.randint(2, 9)))
            return box(rng.choice(_SIDE[kind]), f"<ul>{inner}</ul>" if rng.random() < 0.8 else re.sub("</?li>", " ", inner))
        if kind == "form":
            choice = "<select>" + "".join(f"<option>{text(1, 2, False)}</option>" for _ in range(rng.randint(1, 6))) + "</select>" if rng.random() < 0.4 else ""
            return box(rng.choice(_SIDE[kind]), f"<label>{text(1, 3, False)}</label><input name=q>{choice}<button>{text(1, 2, False)}</button>" + (leaves(False, 1) if rng.random() < 0.3 else ""))
        if kind == "notice" and rng.random() < 0.3:
            return f"<noscript>{box(rng.choice(_SIDE[kind]), text(3, 20, False)) if rng.random() < 0.3 else text(3, 20, False)}</noscript>"
        if kind == "header" and rng.random() < 0.3:
            return box(rng.choice(_SIDE[kind]), f"<svg><text>{text(1, 2, False)}</text></svg>{text(1, 6, False)}")
        if kind == "comments":
            inner = "".join(box(rng.choice([("div", "comment"), ("li", "comment"), ("article", "comment"), ("div", "reply")]), leaves(False, rng.randint(1, 2))) for _ in range(rng.randint(1, 6)))
            return box(rng.choice(_SIDE[kind]), f"<h3>{text(1, 2, False)}</h3>" * rng.randint(0, 1) + inner)
        plain = rng.random() < 0.5
        return box(rng.choice(_SIDE[kind]), text(3, 40, False) if plain else leaves(False, rng.randint(1, 3)))

    some = lambda kind, p: side(kind) if rng.random() < p else ""
    inside = [leaves(True, rng.randint(0, 14))]
    if rng.random() < 0.25:
        inside = [inside[0], side(rng.choice(["ad", "aside", "notice"])), leaves(True, rng.randint(1, 4))]
    title = f"<h1>{text(2, 14, True)}</h1>" if rng.random() < 0.85 else ""
    if rng.random() < 0.15:  # a layout of tables or of divisions without names: length and links must tell
        links = lambda: rng.choice(["<br>", " | ", "</p><p>"]).join(f"<a href={word()}>{text(1, 3, False)}</a>" for _ in range(rng.randint(2, 8)))
        table = rng.random() < 0.6
        cell = lambda inner, kind="": f"<td{kind}>{inner}</td>" if table else f"<div{kind}>{inner}</div>"
        row = lambda *cells: f"<tr>{''.join(cells)}</tr>" if table else "".join(cells)
        body = cell(title.replace("h1", rng.choice(["h1", "h2"])) + "".join(f"<p>{text(8, 150, True)}</p>" for _ in range(rng.randint(1, 8))), rng.choice(["", ' class="content"', " valign=top"]))
        rows = [row(cell(links())), row(*([cell(links())] if rng.random() < 0.7 else []), body, *([cell(links())] if rng.random() < 0.3 else [])), row(cell(text(3, 12, False)))]
        inner = "".join(rows)
        return f"<html><head><title>{word()}</title></head><body>{f'<table>{inner}</table>' if table else inner}</body></html>"
    main = box(rng.choice(_MAIN), title + "".join(inside))
    before = [some("header", 0.4), some("nav", 0.7), some("notice", 0.3), some("ad", 0.5), some("form", 0.2), some("aside", 0.2)]
    after = [some("ad", 0.25), some("comments", 0.4), some("aside", 0.35), some("form", 0.25), some("nav", 0.15), some("footer", 0.8)]
    if rng.random() < 0.3:
        rng.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def made_pages(n: int, seed: int) -> tuple[list[list[Block]], list[list[bool]]]:
    """Blocks and labels of made-up pages."""
    rng, pages, labels = random.Random(seed), [], []
    while len(pages) < n:
        found = blocks(made_page(rng))
        if found:
            labels.append([b.text.startswith(MARK) for b in found])
            for b in found:
                b.text = b.text.removeprefix(MARK) or "-"
            pages.append(found)
    return pages, labels


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, trained once in a process."""
    out = Labeller(seed)
    out.fit(*made_pages(pages, seed), epochs=epochs, seed=seed)
    return out


def extract(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, main text and its length of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(labeller or trained())
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                found = [blocks(x.as_py() or "") for x in b.column(2)]
                texts = ["\n".join(x.text for x, main in zip(page, mask, strict=True) if main) for page, mask in zip(found, model.label(found), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(label, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
