"""Byte-level BPE by a lexicon of frequent words in a minimal acyclic transducer.

The words that a text falls into repeat, so the frequent ones are encoded once and compiled into an
automaton that shares prefixes and suffixes. Its arcs carry numbers whose sum along a word's path is
the word's place in a table of id lists. The file with automaton, table, merges and character classes
is built on the driver, put into the shared folder, fetched by Spark to every executor and memory-mapped
there, once for all workers. Words outside the lexicon are merged exactly, many at a time. The lexicon
thus decides speed and never results.

Work goes block by block of texts in numpy: characters to classes, classes to word spans, spans to
distinct words, those through the automaton or the merges, and back to id sequences.

Defined cases: a null text is an empty one and has no ids; texts of any length are encoded whole; the
special token's string in a text becomes its id. Decoding replaces bytes that are no UTF-8. Rows keep
their other columns; ``n_tokens``, ``ids`` and ``decoded`` of the input are replaced.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import kth_largest, materialize, shared_path
from curatrix.llm.words import blocks, span_hashes, text_buffers

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: Bytes of text that are counted, and encoded, at a time.
COUNT_BYTES, ENCODE_BYTES = 1 << 22, 1 << 21
#: Words in the lexicon at most; words rarer than this share of a block's words aren't sent for it.
LEXICON_WORDS, RARE_SHARE = 100_000, 2e-6
_NONE = np.iinfo(np.int32).max
_SHORT = 64  # bytes; longer words are compared one by one


# -- words of a text -------------------------------------------------------------------------------


def character_classes() -> np.ndarray:
    """The class of every code point, from its general category and the White_Space property."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    # fixed values: the White_Space property
    for c in (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288):
        out[c] = WHITE
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word of UTF-8 ``data``, and the number of words that begin before each offset.

    A word is a run of one class with the single space before it, a contraction, or white space:
    a run of it leaves its last character to what follows, unless the text ends there.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    kind = classes[code]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[np.searchsorted(lead, offsets)] = True
    edge[n] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:-1]
    white = kind == WHITE
    begin = change.copy()
    # The last white character before other text begins a word; if it's a space, that text joins it.
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:-1]
    begin |= last
    joined = np.zeros(n, bool)
    joined[1:] = (last & (code == 32))[:-1]
    begin &= ~joined
    # Contractions: a lone apostrophe that begins a word, before letters of a fixed list.
    quote = np.flatnonzero((code == 39) & begin)
    if len(quote):
        padded = np.concatenate([code, np.zeros(2, np.uint32)])
        closed = np.concatenate([edge, [True, True]])
        a, b = padded[quote + 1], padded[quote + 2]
        one, two = ~closed[quote + 1], ~closed[quote + 1] & ~closed[quote + 2]
        is_one = one & np.isin(a, [ord(c) for c in "stmd"])
        is_two = two & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        begin[quote[is_one | is_two] + 1] = False
        for found, width in ((is_one, 2), (is_two, 3)):
            after = quote[found] + width
            after = after[after < n]
            begin[after[kind[after] == LETTER]] = True
        # What followed the letters began there anyway.
    starts = lead[begin]
    return starts, np.searchsorted(starts, offsets)


# -- the automaton ---------------------------------------------------------------------------------


def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, with numbers on its arcs.

    States are made when no later word can change them, and equal ones are shared: those that are
    final alike and have equal arcs. ``below`` counts a state's words; an arc's number counts the
    words that sort before those behind it.
    """
    register: dict[tuple, int] = {}
    finals, belows, arcs = [], [], []

    def freeze(final: bool, children: list[tuple[int, int]]) -> int:
        key = (final, tuple(children))
        if key not in register:
            register[key] = len(finals)
            finals.append(final)
            belows.append(final + sum(belows[s] for _, s in children))
            arcs.append(children)
        return register[key]

    path: list[list] = [[False, []]]  # the states along the last word: final, finished arcs
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, children = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, children)))

    for word in words:
        same = len(os.path.commonprefix([last, word]))
        close(same)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(*path[0])
    key, to, number = [], [], []
    for state, children in enumerate(arcs):
        before = int(finals[state])
        for byte, target in children:
            key.append(state * 256 + byte)
            to.append(target)
            number.append(before)
            before += belows[target]
    return {"arc": np.array(key, np.int64), "to": np.array(to, np.int32), "number": np.array(number, np.int32), "final": np.array(finals, bool), "root": np.array([root], np.int64)}


def look_up(lexicon: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of each word in the lexicon's table, or -1; all words walk in step."""
    found = np.full(len(starts), -1, np.int64)
    arc = lexicon["arc"]
    if not len(arc):
        return found
    alive, at = np.arange(len(starts)), starts.copy()
    state, total = np.full(len(starts), int(lexicon["root"][0]), np.int64), np.zeros(len(starts), np.int64)
    while len(alive):
        over = at == ends[alive]
        if over.any():
            done = over & lexicon["final"][state]
            found[alive[done]] = total[done]
            alive, at, state, total = alive[~over], at[~over], state[~over], total[~over]
            if not len(alive):
                break
        key = state * 256 + data[at]
        i = np.minimum(np.searchsorted(arc, key), len(arc) - 1)
        there = arc[i] == key
        i = i[there]
        alive, at, state, total = alive[there], at[there] + 1, lexicon["to"][i].astype(np.int64), total[there] + lexicon["number"][i]
    return found


# -- merges ----------------------------------------------------------------------------------------


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in shown):
        out[chr(256 + i)] = b
    return out


def read_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Merges sorted by pair, ids of bytes, bytes of ids, and special tokens of a tokenizer's file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, as_byte = spec["model"]["vocab"], byte_characters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    key = left << 32 | right
    order = np.argsort(key)
    special = [(t["id"], t["content"]) for t in spec.get("added_tokens", [])]
    spelled = {i: bytes(as_byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for i, t in special}
    tokens = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    byte_id = np.zeros(256, np.int32)
    for c, b in as_byte.items():
        byte_id[b] = vocab[c]
    return {
        "pair": key[order], "rank": order.astype(np.int32), "made": made[order], "byte_id": byte_id,
        "token_bytes": np.frombuffer(b"".join(tokens), np.uint8), "token_ptr": np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64),
        "special": np.frombuffer(json.dumps(special).encode(), np.uint8),
    }


def merge_words(model: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the given words one after the other, and how many each has.

    Each round joins, in every word, the pair of least rank wherever it stands, from the left.
    """
    pairs, ranks, made = model["pair"], model["rank"], model["made"]
    lengths = (ends - starts).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - starts, lengths)
    symbols = model["byte_id"][data[at]].astype(np.int64)
    word = np.repeat(np.arange(len(starts)), lengths)
    done_symbols, done_words = [], []

    def rate(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        key = s << 32 | t
        i = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[i] == key, i, -1)

    hit = np.full(len(symbols), -1, np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
    hit[inner] = rate(symbols[inner], symbols[inner + 1])
    while len(symbols):
        rank = np.where(hit >= 0, ranks[hit], _NONE)
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.concatenate([begin, [len(word)]])))
        over = least == _NONE
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            keep = ~over
            symbols, word, hit, rank, least = symbols[keep], word[keep], hit[keep], rank[keep], least[keep]
            if not len(symbols):
                break
        chosen = rank == least
        follows = np.concatenate([[False], chosen[:-1]]) & chosen
        if follows.any():  # equal symbols in a row: every second place counts
            place = np.arange(len(chosen))
            run = place - np.maximum.accumulate(np.where(chosen & ~follows, place, 0))
            chosen &= run % 2 == 0
        to = np.flatnonzero(chosen)
        symbols[to] = made[hit[to]]
        stays = np.ones(len(symbols), bool)
        stays[to + 1] = False
        moved = np.cumsum(stays) - 1
        symbols, word, hit, to = symbols[stays], word[stays], hit[stays], moved[to]
        fresh = np.unique(np.concatenate([to, to[to > 0] - 1]))
        paired = fresh[fresh + 1 < len(word)]
        hit[fresh] = -1
        paired = paired[word[paired] == word[paired + 1]]
        hit[paired] = rate(symbols[paired], symbols[paired + 1])
    if not done_words:
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
    return symbols[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(starts))


def gather(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices ``values[first:first+count]`` one after the other."""
    stop = np.cumsum(counts)
    return values[np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - counts), counts)]


# -- one block -------------------------------------------------------------------------------------


def split_special(data: np.ndarray, offsets: np.ndarray, special: list) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Offsets that also cut at special tokens, and those tokens as (byte, length, id)."""
    raw, found = data.tobytes(), []
    for number, content in special:
        token, at = content.encode(), raw.find(content.encode())
        while at >= 0:
            i = np.searchsorted(offsets, at, "right")
            if at + len(token) <= offsets[i]:
                found.append((at, len(token), number))
                at = raw.find(token, at + len(token))
            else:
                at = raw.find(token, at + 1)
    cuts = [x for at, n, _ in found for x in (at, at + n)]
    return np.unique(np.concatenate([offsets, np.array(cuts, np.int64)])) if cuts else offsets, sorted(found)


def differ(data: np.ndarray, starts: np.ndarray, size: np.ndarray, other: np.ndarray) -> bool:
    """Whether any word is unlike the one that begins at ``other``, which is of its length."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):  # the 8 bytes from each place on as one number
        wide = wide[:-step] | wide[step:] << np.uint64(8 * step)
    left = np.flatnonzero(size <= _SHORT)
    for at in range(0, _SHORT, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        odd = wide[starts[left] + at] ^ wide[other[left] + at]
        odd <<= (8 * np.maximum(at + 8 - size[left], 0)).astype(np.uint64)
        if odd.any():
            return True
    rest = np.flatnonzero((size > _SHORT) & (starts != other))
    return any(not np.array_equal(data[a : a + n], data[b : b + n]) for a, b, n in zip(starts[rest].tolist(), other[rest].tolist(), size[rest].tolist(), strict=True))


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all words, one word of each kind, the kind of each word, and counts of kinds.

    Kinds come from hashes and are held against the bytes of every word; should two words share a
    hash, the block's kinds are told by the words themselves.
    """
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    size = ends - starts
    _, one, kind, count = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    if len(starts) and ((size != size[one[kind]]).any() or differ(data, starts, size, starts[one[kind]])):
        numbers: dict[bytes, int] = {}
        kind = np.array([numbers.setdefault(data[a:b].tobytes(), len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        _, one, count = np.unique(kind, return_index=True, return_counts=True)
    return ends, one, kind, count


def encode_block(model: dict[str, np.ndarray], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block of texts, and the range of each text."""
    data, offsets = text_buffers(column)
    special = json.loads(model["special"].tobytes())
    cut, found = split_special(data, offsets, special)
    starts, _ = word_spans(data, cut, model["classes"])
    ends, one, kind, _ = distinct(data, starts)
    place = look_up(model, data, starts[one], ends[one])
    known = place >= 0
    rest = np.flatnonzero(~known)
    merged, lengths = merge_words(model, data, starts[one[rest]], ends[one[rest]])
    counts, first = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    ptr = model["lexicon_ptr"]
    counts[known], first[known] = ptr[place[known] + 1] - ptr[place[known]], ptr[place[known]]
    counts[rest], first[rest] = lengths, len(model["lexicon_ids"]) + np.cumsum(lengths) - lengths
    table = np.concatenate([model["lexicon_ids"], merged])
    counts, first = counts[kind], first[kind]
    if found:  # the pieces of a special token's string become its id
        base = len(table)
        table = np.concatenate([table, np.array([i for _, _, i in found], np.int32)])
        for k, (at, n, _) in enumerate(found):
            low, high = np.searchsorted(starts, [at, at + n])
            counts[low:high], counts[low], first[low] = 0, 1, base + k
    per_word = np.concatenate([[0], np.cumsum(counts)])
    return gather(table, first, counts), per_word[np.searchsorted(starts, offsets)]


def decode_block(model: dict[str, np.ndarray], ids: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """Texts of ranges of ids."""
    first = model["token_ptr"][ids]
    counts = model["token_ptr"][ids + 1] - first
    data = gather(model["token_bytes"], first, counts).tobytes()
    at = np.concatenate([[0], np.cumsum(counts)])[ptr]
    texts = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    try:
        return pa.array([t.decode("utf-8") for t in texts], pa.string())
    except UnicodeDecodeError:
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())


# -- files -----------------------------------------------------------------------------------------


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file at a URI: a line of JSON with names, types and places, then the arrays at multiples of 64."""
    at, head = 0, {}
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    fs, where = pafs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(where), recursive=True)
    with fs.open_output_stream(where, compression=None) as f:
        f.write(line)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 64))


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of ``save``, mapped into memory and not read."""
    with open(path, "rb") as f:
        line = f.readline()
    whole = np.memmap(path, np.uint8, "r")
    out = {}
    for name, (kind, n, at) in json.loads(line).items():
        low = len(line) + at
        out[name] = whole[low : low + n * np.dtype(kind).itemsize].view(kind)
    return out


# -- operators -------------------------------------------------------------------------------------


def frequent_words(df: DataFrame, text: str, words: int) -> list[bytes]:
    """The most frequent words, sorted as bytes, by counts over all texts.

    A block sends the words that make up RARE_SHARE of it; a word that common overall is sent by
    some block, and no count is short by more than that share. The driver gets ``words`` at most: of
    words that tie for the last place, none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = character_classes()
        for block in blocks(batches, text, COUNT_BYTES):
            data, offsets = text_buffers(block.column(0))
            starts, _ = word_spans(data, offsets, classes)
            ends, one, _, n = distinct(data, starts)
            often = np.flatnonzero(n > max(1, RARE_SHARE * len(starts)))
            yield pa.RecordBatch.from_arrays([pa.array([data[starts[i] : ends[i]].tobytes() for i in one[often].tolist()], pa.binary()), pa.array(n[often])], names=["word", "n"])

    sent = df.select(text).mapInArrow(count, "word binary, n long")
    counted = materialize(sent.groupBy("word").agg(F.sum("n").alias("n")).where(F.octet_length("word") <= 64), "counts")
    least = kth_largest(counted.select(F.col("n").alias("key")), words + 1)
    top = counted if least is None else counted.where(F.col("n") > least)
    return sorted(bytes(r.word) for r in top.select("word").collect())


def build_model(df: DataFrame, text: str, tokenizer_path: str, words: int = LEXICON_WORDS) -> str:
    """The name under which executors find the model's file."""
    spark = df.sparkSession
    model = read_vocabulary(tokenizer_path) | {"classes": character_classes()}
    lexicon = frequent_words(df, text, words)
    data = np.frombuffer(b"".join(lexicon), np.uint8)
    ptr = np.concatenate([[0], np.cumsum([len(w) for w in lexicon])]).astype(np.int64)
    ids, counts = merge_words(model, data, ptr[:-1], ptr[1:])
    model |= compile_lexicon(lexicon) | {"lexicon_ids": ids, "lexicon_ptr": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)}
    name = f"bpe-{uuid.uuid4().hex}.model"
    path = f"{shared_path(spark, 'lexicon')}/{name}"
    save(path, model)
    spark.sparkContext.addFile(path)
    return name


def encode_decode(df: DataFrame, text: str, tokenizer_path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """``df`` with ``n_tokens`` (long), ``ids`` (little-endian unsigned 32-bit) and ``decoded``."""
    model_name = build_model(df, text, tokenizer_path, words)
    df = df.drop("n_tokens", "ids", "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(SparkFiles.get(model_name))
        for block in blocks(batches, text, ENCODE_BYTES):
            ids, ptr = encode_block(model, block.column(block.schema.get_field_index(text)))
            raw, at = ids.astype("<u4").tobytes(), (ptr * 4).tolist()
            packed = pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(np.diff(ptr)), packed, decode_block(model, ids, ptr)], names=[*block.schema.names, "n_tokens", "ids", "decoded"])

    return df.mapInArrow(run, schema)
