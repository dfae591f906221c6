"""Toxicity of documents from misspelling-tolerant lexicon hits in their context.

The lexicon holds insults and stems of insults: a short list given as a parameter, and terms learned from
labelled rows by sequential covering.  Over a bounded sample of them, candidates are words and word
beginnings that stand mostly in toxic texts; the one that explains most not yet explained toxic texts is
taken, those texts then count half, and so on, so that the other words of a much-copied text are not
taken for insults.

Texts meet the lexicon as their distinct words: the sorted words and the trie of the lexicon are walked
together with a Levenshtein automaton of one error: a letter more, less or other, or two neighbours swapped.
Terms and stems below FUZZY letters allow none, no first letter may be wrong (`1diot` and `omron` are no hits), and
the last letter of a stem must be right, as stems begin many words.  Whole ranges of words are dropped at once.  Each hit then weighs by its context: less inside
quotation marks or after a reporting verb, more beside a second person.  A logistic model over the
weights of words, of misspelled words and of stems, each bent after the first hit, is fitted on the
sample and gives the score.

Quotation marks count from the start of the line, however long it is; reporting verbs and second persons within
CONTEXT bytes.  Words of any length are looked up.  Evidence of one kind saturates: weights beyond a sum of MOST
tell no more.

Texts without words have no hits; null texts are empty texts.  Rows without an id are scored and never learned
from; rows that repeat an id are scored each; an empty table gives no rows, and without labels the given list
and fixed scaling are used.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.linear import logistic, probability
from tidemark.llm.quality import labelled_sample
from tidemark.llm.tables import held_out, in_arrow, texts
from tidemark.plans.lineage import cut

# A start for languages without labels; learned terms are added to it.
INSULTS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "idiot", "imbecile", "loser", "moron",
    "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless",
)
# Words that report what somebody else said, and second persons, in the languages of the tables.
REPORTING = frozenset(
    "said says say wrote writes called calls quoted quotes reported dit disait écrit appelé cité sagte sagt schrieb "
    "nannte zitiert dijo dice escribió llamó citó".split()
)
SECOND = frozenset("you your you're youre du dich dir dein ihr euch tu te toi vous tú usted ustedes".split())

FIT_ROWS = 16_000
STEMS = (4, 5, 6)
FUZZY = 5
QUOTED, ADDRESSED = 0.4, 1.25
MOST = 6.0
CONTEXT = 160
EVIDENCE = ("words", "misspelled", "stems")
REMEMBERED = 400_000
_STEM = np.uint64(0x5BD1E9955BD1E995)


class Lexicon(NamedTuple):
    words: tuple[str, ...]
    stems: tuple[str, ...]


class Node:
    """A place in the lexicon's trie."""

    __slots__ = ("next", "letter", "word", "stem", "size", "fuzzy")

    def __init__(self, letter: str, size: int):
        self.next: dict[str, Node] = {}
        self.letter, self.size = letter, size
        self.word = self.stem = self.fuzzy = False


def trie(lexicon: Lexicon) -> Node:
    root = Node("", 0)
    for kind, terms in (("word", lexicon.words), ("stem", lexicon.stems)):
        for term in terms:
            path = [root]
            for c in term:
                path.append(path[-1].next.setdefault(c, Node(c, path[-1].size + 1)))
            setattr(path[-1], kind, True)
            if len(term) >= FUZZY:
                for node in path:
                    node.fuzzy = True
    return root


class Swap(NamedTuple):
    """Between two swapped characters: where the second leads, if it is the one wanted."""

    to: Node
    wanted: str


def _step(states: dict[Node | Swap, int], c: str) -> dict[Node | Swap, int]:
    """The automaton's states after one more character of the word."""
    out: dict[Node | Swap, int] = {}

    def reach(node: Node | Swap, errors: int) -> None:
        if out.get(node, 2) > errors:
            out[node] = errors

    for node, errors in states.items():
        if isinstance(node, Swap):
            if c == node.wanted:
                reach(node.to, 1)
            continue
        if c in node.next:
            reach(node.next[c], errors)
        if errors == 0 and node.size and node.fuzzy:
            reach(node, 1)  # a character too many
            for child in node.next.values():
                if child.fuzzy:
                    reach(child, 1)  # another character
                    if c in child.next:
                        reach(child.next[c], 1)  # a character too few
                        if child.next[c].fuzzy and child.letter != c:
                            reach(Swap(child.next[c], child.letter), 1)  # two characters swapped
    return out


def intersect(vocabulary: list[str], root: Node, exact: frozenset[str] = frozenset()) -> dict[int, int]:
    """Of a sorted list, the places of words that the lexicon accepts: 1 exactly, 2 with one error, 3 by a stem."""
    found: dict[int, int] = {}

    def accepted(states: dict[Node | Swap, int]) -> int:
        best = 0
        for node, errors in states.items():
            if isinstance(node, Swap):
                continue
            if node.word and errors == 0:
                return 1
            if node.word and node.size >= FUZZY:
                best = 2
            if errors == 0 and node.size and any(x.word and x.size >= FUZZY for x in node.next.values()):
                best = 2  # the last character is missing
        return best

    def stem(states: dict[Node | Swap, int], last: str) -> int | None:
        """The errors of a stem that ends here; one with an error ends in a letter of its own, not in the error."""
        return min(
            (errors for node, errors in states.items() if not isinstance(node, Swap) and node.stem
             and (errors == 0 or (node.size >= FUZZY and node.letter == last))),
            default=None,
        )

    def walk(low: int, high: int, depth: int, states: dict[Node | Swap, int]) -> None:
        kind = accepted(states)
        begun = stem(states, vocabulary[low][depth - 1]) if depth else None
        while low < high and len(vocabulary[low]) == depth:
            if kind:
                found[low] = kind
            low += 1
        if begun is not None:
            for i in range(low, high):
                found[i] = 1 if begun == 0 and vocabulary[i] in exact else 3
        if begun == 0:
            return
        while low < high:
            word = vocabulary[low]
            c = word[depth]
            end = bisect_left(vocabulary, word[:depth] + chr(ord(c) + 1), low, high) if ord(c) < 0x10FFFF else high
            after = _step(states, c)
            if after:
                walk(low, end, depth + 1, after)
            low = end

    walk(0, len(vocabulary), 0, {root: 0})
    return found


class Matcher:
    """Finds the words of texts that the lexicon accepts; distinct words are looked up once."""

    def __init__(self, lexicon: Lexicon):
        self.root, self.exact = trie(lexicon), frozenset(lexicon.words)
        self.seen, self.kind = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def kinds(self, found: W.Words) -> np.ndarray:
        """0, 1, 2 or 3 for each word."""
        h = W.word_hashes(found)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.seen) > REMEMBERED:
            self.seen, self.kind = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        known = np.isin(distinct, self.seen)
        new = first[~known]
        raw = found.data.tobytes()
        named = sorted(
            (raw[s:e].decode("utf-8", "replace"), x)
            for s, e, x in zip(found.start[new].tolist(), found.end[new].tolist(), h[new].tolist(), strict=True)
        )
        hits = intersect([word for word, _ in named], self.root, self.exact)
        kind = np.zeros(len(new), np.int8)
        if hits:
            hashes = np.array([named[i][1] for i in hits], np.uint64)
            order = np.argsort(hashes)
            at = np.searchsorted(hashes[order], distinct[~known])
            at = np.minimum(at, len(hashes) - 1)
            same = hashes[order][at] == distinct[~known]
            kind[same] = np.array(list(hits.values()), np.int8)[order][at[same]]
        self.seen = np.concatenate([self.seen, distinct[~known]])
        self.kind = np.concatenate([self.kind, kind])
        order = np.argsort(self.seen)
        self.seen, self.kind = self.seen[order], self.kind[order]
        return self.kind[np.searchsorted(self.seen, distinct)][back]


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
# Quotation marks in UTF-8.
_OPENING, _CLOSING, _ENDING = ("|".join(c).encode() for c in ("“«„", "”»", "”»“"))


class Marks(NamedTuple):
    """Places of line feeds and quotation marks in the bytes of some texts."""

    feed: np.ndarray
    plain: np.ndarray
    opening: np.ndarray
    closing: np.ndarray
    ending: np.ndarray  # closing ones, and the mark that ends a quotation in some languages and opens it in others


def marks(raw: bytes) -> Marks:
    found = ([m.start() for m in re.finditer(p, raw)] for p in (b"\n", b'"', _OPENING, _CLOSING, _ENDING))
    return Marks(*(np.array(x, np.int64) for x in found))


def quoted(at: Marks, low: np.ndarray, start: np.ndarray, end: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each stretch lies in a quotation of its line, wherever in it; `low` and `high` are the text's ends."""

    def count(places, a, b):
        return np.searchsorted(places, b) - np.searchsorted(places, a)

    def last(places, a, b):
        i = np.searchsorted(places, b)
        return np.where(count(places, a, b) > 0, np.append(places, -1)[i - 1], -1)

    low = np.maximum(low, last(at.feed, low, start) + 1)
    feeds = np.append(at.feed, np.iinfo(np.int64).max)
    high = np.minimum(high, feeds[np.searchsorted(at.feed, end)])
    plain = (count(at.plain, low, start) % 2 == 1) & (count(at.plain, end, high) > 0)
    return plain | ((last(at.opening, low, start) > last(at.closing, low, start)) & (count(at.ending, end, high) > 0))


def context_weight(before: str, after: str, in_quotes: bool) -> float:
    """The weight of a hit, inside a quotation or not, between the stretches of text beside it."""
    line = before.rpartition("\n")[2]
    near = [w.lower() for w in _WORD.findall(line)[-6:]]
    weight = QUOTED if in_quotes or REPORTING & set(near) else 1.0
    if SECOND & {*near, *(w.lower() for w in _WORD.findall(after.partition("\n")[0])[:3])}:
        weight *= ADDRESSED
    return weight


def evidence(rows: pa.Array, matcher: Matcher) -> np.ndarray:
    """For each text the weights of its words, its misspelled words and its stems, each at most MOST."""
    out = np.zeros((len(rows), 3))
    for a, b in W.slices(rows):
        found = W.words(rows.slice(a, b - a), W.LETTERS, True)
        kind = matcher.kinds(found)
        hits = np.flatnonzero(kind)
        if not len(hits):
            continue
        data, offsets = W.bytes_of(rows.slice(a, b - a))
        doc = np.searchsorted(found.first, hits, "right") - 1
        said = quoted(marks(data.tobytes()), offsets[doc], found.start[hits], found.end[hits], offsets[doc + 1])
        for i, d, q in zip(hits.tolist(), doc.tolist(), said.tolist(), strict=True):
            if out[a + d, kind[i] - 1] >= MOST:
                continue
            s, e = int(found.start[i]), int(found.end[i])
            before = data[max(int(offsets[d]), s - CONTEXT) : s].tobytes().decode("utf-8", "ignore")
            after = data[e : min(int(offsets[d + 1]), e + CONTEXT)].tobytes().decode("utf-8", "ignore")
            out[a + d, kind[i] - 1] += context_weight(before, after, q)
    return np.minimum(out, MOST)


def bent(x: np.ndarray) -> np.ndarray:
    """Columns of a piecewise linear function of each column: up to 1, from 1 to 2, and beyond."""
    return np.concatenate([np.minimum(x, 1), np.clip(x - 1, 0, 1), np.maximum(x - 2, 0)], axis=1)


def _terms(found: W.Words):
    """Hash, text number and (start, end) of every word and of every stem of every longer word."""
    doc = found.doc()
    yield W.word_hashes(found), doc, found.start, found.end
    for size in STEMS:
        some = np.flatnonzero(found.end - found.start > size)
        # A stem ends between characters.
        some = some[(found.data[found.start[some] + size] & 0xC0) != 0x80]
        cut_off = found._replace(start=found.start[some], end=found.start[some] + size)
        yield W.word_hashes(cut_off) ^ _STEM, doc[some], cut_off.start, cut_off.end


def learn(labelled: DataFrame, start: tuple[str, ...] = INSULTS) -> Lexicon:
    """A lexicon from `doc_id, text, label`, a bounded table."""

    def count(batch: pa.RecordBatch):
        label = batch["label"].to_numpy(zero_copy_only=False)
        for a, b in W.slices(batch["text"], 2 << 20):
            found = W.words(batch["text"].slice(a, b - a), W.LETTERS, True)
            hashes, docs = (np.concatenate(x) for x in zip(*[(h, d) for h, d, _, _ in _terms(found)], strict=True))
            order = np.lexsort((docs, hashes))
            hashes, docs = hashes[order], docs[order]
            once = np.ones(len(hashes), bool)
            once[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
            hashes, toxic = hashes[once], label[a:b][docs[once]]
            term, place = np.unique(hashes, return_inverse=True)
            n1 = np.bincount(place, toxic, len(term)).astype(np.int64)
            yield {"term": W.signed(term), "n0": np.bincount(place, minlength=len(term)) - n1, "n1": n1}

    rows = cut(labelled, "labelled")
    totals = rows.agg(F.sum("label").alias("toxic")).first()
    toxic = int(totals["toxic"] or 0)
    if not toxic:
        return Lexicon(tuple(start), ())
    # Three toxic texts at least, and twenty for each clean one.
    counted = in_arrow(rows.select("text", "label"), count, "term bigint, n0 bigint, n1 bigint")
    candidates = (
        counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n1") >= max(3, toxic // 200))
        .where(F.col("n1") >= F.lit(20) * F.col("n0")).toPandas()
    )
    wanted = np.sort(candidates["term"].to_numpy(np.int64))
    if not len(wanted):
        return Lexicon(tuple(start), ())

    def show(batch: pa.RecordBatch):
        ids = batch["doc_id"]
        for a, b in W.slices(batch["text"], 2 << 20):
            found = W.words(batch["text"].slice(a, b - a), W.LETTERS, True)
            raw = found.data.tobytes()
            for k, (h, docs, s, e) in enumerate(_terms(found)):
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == h)
                pairs = {(int(docs[i]), raw[int(s[i]) : int(e[i])].decode("utf-8", "replace")) for i in hit}
                yield {
                    "doc_id": ids.slice(a, b - a).take(pa.array([d for d, _ in pairs], pa.int64())),
                    "term": pa.array([t for _, t in pairs], pa.string()), "stem": pa.array([k > 0] * len(pairs)),
                }

    shown = in_arrow(rows.where("label = 1").select("doc_id", "text"), show, "doc_id bigint, term string, stem boolean").distinct().toPandas()
    return _cover(shown, toxic, start)


def _cover(shown, toxic: int, start: tuple[str, ...]) -> Lexicon:
    """Takes the term that explains most, halves what its texts count, and goes on."""
    doc, _ = shown["doc_id"].factorize()
    term, names = shown.assign(key=list(zip(shown["stem"], shown["term"], strict=True)))["key"].factorize()
    weight = np.ones(doc.max() + 1 if len(doc) else 0)
    given = np.array([not stem and word in start for stem, word in names], bool)
    of_term = np.split(doc[np.argsort(term, kind="stable")], np.cumsum(np.bincount(term, minlength=len(names)))[:-1])
    for k in np.flatnonzero(given):
        weight[of_term[k]] *= 0.5
    words, stems, least = list(start), [], max(1.5, 0.004 * toxic)
    left = ~given
    while left.any():
        gain = np.bincount(term, weight[doc], len(names)) * left
        best = int(gain.argmax())
        if gain[best] < least:
            break
        # Of terms that explain nearly as much the whole word is the safest, then the longest stem.
        close = np.flatnonzero((gain >= 0.9 * gain[best]) & left)
        same = [k for k in close if len(np.intersect1d(of_term[k], of_term[best])) >= 0.9 * len(of_term[best])
                and (names[k][1].startswith(names[best][1]) or names[best][1].startswith(names[k][1]))]
        best = max(same or [best], key=lambda k: (not names[k][0], len(names[k][1])))
        (stems if names[best][0] else words).append(names[best][1])
        weight[of_term[best]] *= 0.5
        left[best] = False
        for k in np.flatnonzero(left):
            if names[best][0] and names[k][1].startswith(names[best][1]):
                left[k] = False
    return Lexicon(tuple(dict.fromkeys(words)), tuple(dict.fromkeys(stems)))


class Model(NamedTuple):
    lexicon: Lexicon
    scale: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon and scaling from about `fit_rows` labelled rows of `doc_id, text`."""
    rows = cut(labelled_sample(docs, labels, label, folds, fold, fit_rows), "fit")
    lexicon = learn(rows)

    def run(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            x = evidence(batch["text"], matcher)
            yield pa.RecordBatch.from_arrays([batch["label"], *(pa.array(c) for c in x.T)], ["label", *EVIDENCE])

    seen = rows.select("text", "label").mapInArrow(run, "label int, " + ", ".join(f"{c} double" for c in EVIDENCE)).toPandas()
    if seen["label"].nunique() < 2:
        return Model(lexicon, np.array([2.0, 1.0, 1.0] * 3 + [-3.0]))
    return Model(lexicon, logistic(bent(seen[list(EVIDENCE)].to_numpy()), seen["label"].to_numpy(float), ridge=0.1))


def scores(rows: pa.Array, matcher: Matcher, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and score of each text."""
    x = evidence(rows, matcher)
    return x, probability(bent(x) @ model.scale[:-1] + model.scale[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, words, misspelled, stems, score` of every row of `doc_id, text`."""

    def run(batches):
        matcher = Matcher(model.lexicon)
        for batch in batches:
            x, p = scores(batch["text"], matcher, model)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in x.T), pa.array(p)], ["doc_id", *EVIDENCE, "score"])

    return docs.mapInArrow(run, f"doc_id bigint, {', '.join(f'{c} double' for c in EVIDENCE)}, score double")


def toxicity(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1,
    fit_rows: int = FIT_ROWS, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """`doc_id, held_out, words, misspelled, stems, score, predicted` of every document row."""
    docs = texts(documents, doc_col, text_col)
    model = fit(docs, labels, label_col, folds, fold, fit_rows)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), *EVIDENCE, "score",
        F.when(F.col("score") >= F.lit(threshold), 1).otherwise(0).alias("predicted"),
    )


def without_toxic(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1,
    fit_rows: int = FIT_ROWS, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """The rows of `documents`, with all their columns, whose score is below the threshold."""
    model = fit(texts(documents, doc_col, text_col), labels, label_col, folds, fold, fit_rows)

    def run(batches):
        matcher = Matcher(model.lexicon)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch[text_col], matcher, model)[1] < threshold))

    return documents.mapInArrow(run, documents.schema)
