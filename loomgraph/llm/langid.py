"""Language identification by cross-parsing entropy.

Training takes a bounded sample of labelled text for each language, of all languages: about DOCS documents by a hash of
their id, of each a window of DOC_CHARS characters at a hashed offset, CHARS characters in all, and builds a suffix
automaton of it. A text is parsed greedily against each automaton: the longest match from the current place is one
phrase, then the next phrase starts. A phrase is a place in the sample, so it costs log2 of the sample's length in bits;
the language whose phrases cost the fewest bits a letter wins. So a short sample, whose matches are short, isn't at a
disadvantage for that alone.

Text is reduced to lower-case letters and single spaces. The transitions of all automata, each over all letters of its
own sample, are in one table: dense (states x letters, int32) up to DENSE_BYTES, else open-addressed by a hash of state
and letter, with the same results and about four times slower. A letter that a sample lacks has no transition, is a
phrase of its own, and costs log2 of the number of letters besides, to say which. Texts are parsed in segments of SEGMENT characters, all segments of a piece of a batch and all
languages in step, as array operations; a segment is then parsed again from the state in which the one before it ended,
as far as both parses differ, so that the phrases are those of one parse of the whole text.

The model is broadcast. A hashed language has at most 3 CHARS transitions, of 24 to 48 bytes: 6 MB; time a text grows
with the number of languages. Root transitions are held as languages x letters x 4 bytes.
Rows are independent; nothing is shuffled. Training collects at most about DOCS x DOC_CHARS characters a language.

Defined cases: null texts and texts without a letter are `und` with score 0; with no labelled text everything is
`und`; a label that is null isn't learnt; ties go to the first language in code-point order; a text of any length is
parsed whole, in memory in proportion to it; repeated rows are predicted each for themselves; an empty table gives no
rows; columns that are not named in the arguments are ignored, whatever their names; a name in keep that the result has
already is refused.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, read, remainder, unit

#: Bounds of the training sample: documents of a language, characters taken of each, characters in all.
DOCS = 150
DOC_CHARS = 4_000
CHARS = 40_000
SEGMENT = 2048
#: Steps after which a parse is compared with an earlier one of the same segment.
MARK = 64
#: Largest dense table.
DENSE_BYTES = 192_000_000
#: Rows of the table of languages that is sent to every task.
BROADCAST_LANGUAGES = 20_000
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


def automaton(text: np.ndarray) -> tuple[int, np.ndarray]:
    """The suffix automaton of a sequence of letters: its number of states, and its transitions as rows (state, letter, next)."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return len(moves), np.array([(s, c, t) for s, own in enumerate(moves) for c, t in own.items()], np.int64).reshape(-1, 3)


class _Letters(dict):
    """Code point -> itself for letters, a space for all else; filled as they come."""

    def __missing__(self, point: int) -> int:
        out = self[point] = point if chr(point).isalpha() else 32
        return out


_LETTERS = _Letters()


def letters(text: str) -> str:
    """Lower-case letters, and one space for each run of anything else."""
    return " ".join(text.lower().translate(_LETTERS).split())


class Model:
    """languages; code: code point -> letter of the alphabet (the last one stands for all others); keys and values: the hash
    table of all transitions, key -1 where it is free, or dense: the next state by key; roots: the transitions of each language's first state."""

    def __init__(self, samples: dict[str, str], dense_bytes: int = DENSE_BYTES):
        self.languages = sorted(samples)
        chosen = sorted({c for s in samples.values() for c in s})
        n = self.size = len(chosen) + 1
        self.code = np.full(max(map(ord, chosen), default=0) + 2, n - 1, np.int32)
        self.code[[ord(c) for c in chosen]] = np.arange(n - 1, dtype=np.int32)
        edges, starts, at = [np.zeros((0, 3), np.int64)], [], 0
        for lang in self.languages:
            states, own = automaton(self.encode(samples[lang]))
            edges.append(own + np.array([at, 0, at]))
            starts.append(at)
            at += states
        self.starts = np.array(starts, np.int64)
        self.bits = np.array([np.log2(max(2, len(samples[lang]))) for lang in self.languages])
        rows = np.concatenate(edges)
        keys, values = rows[:, 0] * n + rows[:, 1], rows[:, 2].astype(np.int32)
        self.dense = None
        if 4 * at * n <= dense_bytes:
            self.dense = np.full(max(1, at) * n, -1, np.int32)
            self.dense[keys] = values
        else:
            self._hash(keys, values)
        self.roots = self.moves(np.repeat(self.starts[:, None], n, 1) * n + np.arange(n)).astype(np.int32)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.wide = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.wide, -1, np.int64), np.zeros(1 << self.wide, np.int32)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.wide) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * MIX >> np.uint64(64 - self.wide)).astype(np.int64)

    def moves(self, keys: np.ndarray) -> np.ndarray:
        """The next state of each key (state * size + letter); -1: no transition."""
        if self.dense is not None:
            return self.dense[keys]
        wanted = keys.reshape(-1)
        at = self._slots(wanted)
        found = self.keys[at]
        out = np.where(found == wanted, self.values[at], -1)
        again = np.flatnonzero((found != wanted) & (found >= 0))
        wanted, at = wanted[again], at[again]
        while len(again):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == wanted
            out[again[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            again, wanted, at = again[more], wanted[more], at[more]
        return out.reshape(keys.shape)

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return self.code[np.minimum(points, len(self.code) - 1)]

    def parse(self, block: np.ndarray, lengths: np.ndarray, state: np.ndarray, count: np.ndarray):
        """Read the columns of block (letters by step, the longest column first) from the given states, in place; after
        each MARK steps, and at the end, yields the step reached."""
        root = self.starts[:, None]
        live = np.searchsorted(-lengths, -np.arange(len(block)), side="left")  # columns longer than each step
        for step, n in enumerate(live.tolist()):
            c = block[step, :n].astype(np.int64)
            now = state[:, :n]
            s = self.moves(now * self.size + c)
            miss = s < 0
            count[:, :n] += miss | (now == root)  # a phrase starts where none is open or the open one can't go on
            if miss.any():
                s = np.where(miss, self.roots[:, c], s)
                s = np.where(s < 0, root, s)  # the sample lacks the letter: a phrase of its own
            state[:, :n] = s
            if (step + 1) % MARK == 0 or step + 1 == len(block):
                yield step + 1

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (of letters() form) against each language: those of one greedy parse from its first letter.

        Segments of SEGMENT letters are parsed side by side, at first as if a phrase began at each. Then those whose
        predecessor ended in another state are parsed again from there, as far as the first mark where they are in the
        state they were in before; from it on nothing differs.
        """
        k, parts, owner, first = len(self.languages), [], [], []
        for i, t in enumerate(texts):
            codes = self.encode(t)
            for a in range(0, len(codes), SEGMENT):
                parts.append(codes[a : a + SEGMENT])
                owner.append(i)
                first.append(a == 0)
        out = np.zeros((len(texts), k), np.int64)
        if not parts or not k:
            return out
        m, root = len(parts), self.starts[:, None]
        began = np.repeat(root, m, 1)
        ended, total = began.copy(), np.zeros((k, m), np.int32)
        marks = -(-max(map(len, parts)) // MARK)
        passed, counted = np.full((marks, k, m), -1, np.int32), np.zeros((marks, k, m), np.int32)
        todo = np.arange(m)
        while len(todo):
            size = np.array([len(parts[i]) for i in todo.tolist()])
            order = np.argsort(-size, kind="stable")
            cols, size = todo[order], size[order]
            block = np.full((size[0], len(cols)), self.size - 1, np.int32)
            for j, i in enumerate(cols.tolist()):
                block[: size[j], j] = parts[i]
            state, count = np.ascontiguousarray(began[:, cols]), np.zeros((k, len(cols)), np.int32)
            open_ = np.ones(len(cols), bool)
            for step in self.parse(block, size, state, count):
                at = (step - 1) // MARK
                here = np.flatnonzero(open_ & (size > at * MARK))
                own = cols[here]
                same = (passed[at][:, own] == state[:, here]).all(0)
                shift = count[:, here] - counted[at][:, own]
                passed[at][:, own], counted[at][:, own] = state[:, here], count[:, here]
                met = own[same]
                counted[at + 1 :, :, met] += shift[:, same]
                total[:, met] += shift[:, same]
                open_[here[same]] = False
                over = here[~same & (size[here] <= step)]
                ended[:, cols[over]], total[:, cols[over]] = state[:, over], count[:, over]
                open_[over] = False
                if not open_.any():
                    break
            wanted = np.where(np.array(first), root, np.roll(ended, 1, 1))
            todo = np.flatnonzero((wanted != began).any(0))
            began = wanted
        np.add.at(out, np.array(owner), total.T)
        return out

    def foreign(self, texts: list[str]) -> np.ndarray:
        """Letters of each text that each language's sample lacks."""
        lacks = (self.roots < 0).astype(np.int64)
        return np.array([lacks @ np.bincount(self.encode(t), minlength=self.size) for t in texts]).reshape(len(texts), -1)

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        reduced = [letters(t) if t else "" for t in texts]
        costs = self.phrases(reduced) * self.bits + self.foreign(reduced) * np.log2(max(2, self.size))
        langs, scores, rates = [], [], []
        for t, c in zip(reduced, costs.tolist()):
            if not t or not c:
                langs.append(UNKNOWN)
                scores.append(0.0)
                rates.append(None)
                continue
            best = min(range(len(c)), key=c.__getitem__)
            rest = min((x for i, x in enumerate(c) if i != best), default=2 * c[best])
            langs.append(self.languages[best])
            scores.append(rest / (rest + c[best]))
            rates.append(c[best] / len(t))
        return {"lang_pred": langs, "score": scores, "bits_a_letter": rates}


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """labelled: rows to learn from. A language's documents are those of the lowest id hashes."""
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL")
    share = cut(labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(DOCS)) / F.count("*")).alias("share")))
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share
    start = F.pmod(F.xxhash64(F.lit("langid window"), "id"), F.greatest(F.length("text") - DOC_CHARS, F.lit(0)) + 1) + 1
    rows = labelled.where("text IS NOT NULL").withColumn("h", unit(F.col("id"), "langid")).join(share, "lang").where("h <= share")
    rows = rows.select("lang", "h", F.substring("text", start.cast("int"), F.lit(DOC_CHARS)).alias("text"))
    found: dict[str, set] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r["lang"], set()).add((r["h"], r["text"]))
    samples = {}
    for lang, rows_ in found.items():
        seen: set[str] = set()
        lines = []
        for _, text in sorted(rows_):
            for line in text.split("\n"):  # lines that repeat teach nothing new
                if (x := letters(line)) and x not in seen:
                    seen.add(x)
                    lines.append(x)
        samples[lang] = " ".join(lines)[:CHARS]
    return Model({k: s for k, s in samples.items() if s})


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, lang_pred, score (0.5 to 1: the next language's share of the bits of both) and bits_a_letter (the best one's)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, "lang_pred string, score double, bits_a_letter double", lambda texts: sent.value.predict(texts), text_col)


def held_out(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the language of every document."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits_a_letter")
