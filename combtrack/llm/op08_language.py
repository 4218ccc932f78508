"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, slices

_LETTER = re.compile(r"[^\W\d_]")
#: Symbols of the automata: 26 letters, 32 trailing bytes, 4 kinds of leading bytes, one separator.
ALPHABET, SEPARATOR = 64, 63


def _symbols() -> np.ndarray:
    out = np.full(256, SEPARATOR, np.uint8)
    for i in range(26):
        out[97 + i] = out[65 + i] = i
    for b in range(0x80, 0xC0):
        out[b] = 26 + (b & 31)
    for b in range(0xC2, 0xF5):
        out[b] = 58 if b in (0xC3, 0xC5) else 59 if b < 0xE0 else 60 if b < 0xF0 else 61
    return out


SYMBOLS = _symbols()


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, with runs of non-letters as one separator, and each text's offset in them."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    seq = SYMBOLS[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in raw])
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != SEPARATOR) | (seq[:-1] != SEPARATOR)
    offsets = np.concatenate(([0], np.cumsum(keep)[ends - 1]))
    return seq[keep], offsets


class SuffixAutomaton:
    """The smallest automaton that reads every substring of a sequence of symbols."""

    def __init__(self, seq) -> None:
        moves, link, length = [{}], [-1], [0]
        last = 0
        for c in map(int, seq):
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in moves[at]:
                moves[at][c] = new
                at = link[at]
            if at >= 0:
                to = moves[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    split = len(moves)
                    moves.append(dict(moves[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and moves[at].get(c) == to:
                        moves[at][c] = split
                        at = link[at]
                    link[to] = link[new] = split
            last = new
        self.moves = moves

    def table(self) -> np.ndarray:
        """For each state and symbol 2 * the next state's row, plus 1 where the match ends and a phrase begins anew."""
        first = np.zeros(ALPHABET, np.int32)
        for c, to in self.moves[0].items():
            first[c] = to
        out = np.tile(first * ALPHABET * 2 + 1, (len(self.moves), 1)).astype(np.int32)
        for state, row in enumerate(self.moves):
            for c, to in row.items():
                out[state, c] = to * ALPHABET * 2
        out[0] |= 1  # a phrase begins with every move away from the root, also behind a symbol that the sample lacks
        return out.ravel()


def phrases(table: np.ndarray, starts: np.ndarray, seq: np.ndarray, offsets: np.ndarray, segment: int = 1024) -> np.ndarray:
    """Phrases that the greedy cross-parse of each whole text needs, (texts, languages).

    table: the languages' tables one after another, starts: where each begins. All segments of all texts advance in
    step, one symbol at a time, each as if a phrase began with it. Then the parse of each segment goes on into the next
    one until a phrase begins where one of that segment's own does, from where on both are the same; if none does, the
    next segment ends in another state, and what follows is done again. So the result doesn't depend on `segment`.
    """
    size = np.diff(offsets)
    parts = -(-size // segment)
    owner = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][owner] + nth * segment
    length = np.minimum(segment, offsets[1:][owner] - begin)
    order = np.argsort(-length, kind="stable")
    base = np.asarray(starts, np.int32)[:, None]
    state = np.repeat(base, len(owner), axis=1)
    fresh = np.zeros((len(starts), len(seq)), bool)  # where a phrase begins in the parse of a segment
    fresh[:, begin] = True
    active = np.searchsorted(-length[order], -np.arange(1, (length.max() if len(length) else 0) + 1), "right")
    at = begin[order]
    for t, k in enumerate(active):
        value = table[state[:, :k] + seq[at[:k] + t]]
        if t:
            fresh[:, at[:k] + t] = value & 1
        state[:, :k] = (value >> 1) + base
    end = np.empty_like(state)
    end[:, order] = state
    count = np.add.reduceat(fresh, begin, axis=1, dtype=np.int64) if len(begin) else np.zeros((len(starts), 0), np.int64)
    own, last = count.copy(), end.copy()  # of segments parsed from their first symbol
    lang, part = np.nonzero(np.repeat((nth > 0)[None, :], len(starts), axis=0))
    while len(part):  # segments whose predecessor's end has changed
        now, t = end[lang, part - 1], 0
        total, missed = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)  # phrases begun by this parse, and by the segment's own
        left = np.arange(len(part))
        met = np.zeros(len(part), bool)
        while len(left):
            left = left[t < length[part[left]]]
            place = begin[part[left]] + t
            value = table[now[left] + seq[place]]
            new, old = (value & 1).astype(bool), fresh[lang[left], place]
            now[left] = (value >> 1) + base[lang[left], 0]
            same = new & old
            met[left[same]] = True
            total[left] += new & ~same
            missed[left] += old & ~same
            left, t = left[~same], t + 1
        ends = np.where(met, last[lang, part], now)
        count[lang, part] = own[lang, part] + total - missed
        changed = ends != end[lang, part]
        end[lang, part] = ends
        more = changed & (part + 1 < len(owner))
        more[more] &= nth[part[more] + 1] > 0
        lang, part = lang[more], part[more] + 1
    out = np.zeros((len(size), len(starts)), np.int64)
    np.add.at(out, owner, count.T)
    return out


_TABLES: dict = {}


def _tables(model: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = hash(model)
    if key not in _TABLES:
        _TABLES.clear()
        tables, starts, logs = [], [], []
        for _, text in model:
            seq, _ = fold([text])
            starts.append(sum(map(len, tables)))
            tables.append(SuffixAutomaton(seq).table())
            logs.append(np.log2(max(2, len(seq))))
        _TABLES[key] = np.concatenate(tables), np.array(starts), np.array(logs)
    return _TABLES[key]


def learn_languages(docs: DataFrame, learnable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 16, long_chars: int = 5_000, max_languages: int = 64) -> tuple[tuple[str, str], ...]:
    """(language, text) pairs: the whole texts from which the automata are built.

    For each non-null language these are `sample_docs` learnable documents, those with the lowest hash of their id
    among documents of up to `long_chars` characters; a language that has fewer gives its shortest longer ones too. Copies
    count once. Null ids and texts and languages of which the sample has no letter are left out. Labels are few: more
    than `max_languages` are an error.
    """
    rows = docs.where(learnable & docs[lang_col].isNotNull() & docs[id_col].isNotNull() & docs[text_col].isNotNull())
    rows = rows.select(docs[id_col].cast("string").alias("id"), docs[lang_col].alias("lang"), F.xxhash64(docs[text_col]).alias("h"), F.greatest(F.length(docs[text_col]), F.lit(long_chars)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("n", F.xxhash64("id"), "id", "h"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= sample_docs).limit(sample_docs * max_languages + 1).collect()
    if len(chosen) > sample_docs * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    wanted = {(r["id"], r["lang"], r["h"]): r["rank"] for r in chosen}
    key = docs[id_col].cast("string")
    texts = docs.where(key.isin([r["id"] for r in chosen]) & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(key, docs[lang_col], F.xxhash64(docs[text_col]), docs[text_col]).distinct().collect() if chosen else []
    by_lang: dict[str, list] = defaultdict(list)
    for i, lang, h, text in texts:
        if (i, lang, h) in wanted:
            by_lang[lang].append((wanted[i, lang, h], text))
    out = []
    for lang, found in sorted(by_lang.items()):
        kept = "\n".join(dict.fromkeys(text for _, text in sorted(found)))  # a copy adds nothing
        if _LETTER.search(kept):
            out.append((lang, kept))
    return tuple(out)


def identify_language(docs: DataFrame, model: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text", keep: bool = False, segment: int = 1024) -> DataFrame:
    """(doc_id, lang_pred, score, bits), or all columns and these three with `keep`.

    Every whole text is parsed greedily into the longest phrases that occur in a language's sample; the language with
    the fewest phrases, each weighted by the bits of a pointer into the sample, wins (ties: the first by name); `bits`
    are its bits a symbol, the cross-parsing entropy. Null texts, texts without a letter and an empty model give `und`
    with score 0 and null bits; otherwise the score is the runner-up's share of the two lowest costs, 0.5 to 1.
    Repeated rows get equal results; null ids are kept. Other columns stay; where one has the name of a result, that
    gets an underscore more. `segment` deals the work out and changes nothing.
    """
    names = [lang for lang, _ in model]

    def run(batches):
        table, starts, logs = _tables(model) if model else (None, np.zeros(0), np.zeros(0))
        for batch in slices(batches, text_col, 1 << 21):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            lang, score, bits = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if model:
                seq, offsets = fold(texts)
                cost = phrases(table, starts, seq, offsets, segment) * logs
                order = np.argsort(cost, axis=1, kind="stable")
                for i, text in enumerate(texts):
                    if _LETTER.search(text):
                        lang[i] = names[order[i, 0]]
                        low = cost[i, order[i, 0]]
                        high = cost[i, order[i, 1]] if len(names) > 1 else low
                        score[i] = high / max(low + high, 1e-9)
                        bits[i] = low / (offsets[i + 1] - offsets[i])
            held = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*held, pa.array(lang, pa.string()), pa.array(score), pa.array(bits, pa.float64())], [*columns, *new])

    if keep:
        source = docs
    else:
        source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
        id_col, text_col = "doc_id", "text"
    columns = source.columns if keep else ["doc_id"]
    new = [free_name(x, columns) for x in ("lang_pred", "score", "bits")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in columns)
    return source.mapInArrow(run, f"{fields}, `{new[0]}` string, `{new[1]}` double, `{new[2]}` double")
