"""SQL equivalents of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from packloom.operators.strategies import POOL_PACKS, WINDOW_ROWS
from packloom.plans.flows import CHAT, CHAT_CAPPED, DOCS, EOS, FIRST_WORD_ID
from packloom.plans.queries import (
    BATCH,
    LOSS_BATCH,
    MAX_SAMPLES,
    ORDERS,
    RANDOM_SEED,
    RESERVOIR,
    RESUME,
    ROW_SAMPLES,
    ROW_TOKENS,
    SEED,
    SMALL_WINDOW,
    VECTOR_SIZE,
)
from packloom.streaming.packer import LANE_ROWS, MIN_LANES

ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
POINTS = "CASE WHEN {0} = '' THEN [] ELSE list_transform(string_split({0}, ''), lambda c: unicode(c)) END"


def text_of(values: str) -> str:
    return f"md5(array_to_string({values}, ','))"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


# --- building blocks ----------------------------------------------------------------------------

CHAT_TRIPLETS = """
turns AS (SELECT * FROM conversations),
first_answer AS (
  SELECT conv_id, arg_min(text, turn) AS text FROM turns WHERE role = 'assistant' GROUP BY conv_id
),
triplets AS (
  SELECT u.conv_id, u.turn, u.text AS anchor, a.text AS positive, n.text AS negative
  FROM turns u
  JOIN turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN first_answer n ON n.conv_id = u.conv_id + 1
  WHERE u.role = 'user'
)"""

DOC_TRIPLETS = """
triplets AS (
  SELECT d.doc_id, d.source, d.text AS anchor, p.text AS positive, n.text AS negative, l.quality
  FROM documents d
  LEFT JOIN documents p ON p.doc_id = d.doc_id + 1
  LEFT JOIN documents n ON n.doc_id = d.doc_id + 2
  LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

USABLE = """
usable AS (
  SELECT * FROM triplets
  WHERE coalesce(anchor, '') <> '' AND coalesce(positive, '') <> '' AND coalesce(negative, '') <> ''
)"""


def tokenized(keys: str, tokens: str = POINTS) -> str:
    """Slots a, p, n with EOS appended."""
    slots = ", ".join(
        f"list_append({tokens.format(text)}, {EOS}) AS {slot}"
        for slot, text in (("a", "anchor"), ("p", "positive"), ("n", "negative"))
    )
    return f"\ntokenized AS (SELECT {keys}, {slots} FROM usable)"


def limited(order: str, limit: int | None, keys: str = "") -> str:
    """Length filter and cut: rn, len, ids, labels and positions of the kept samples."""
    where = "" if limit is None else f"WHERE len(a) + len(p) < {limit}"
    end = "len(a) + len(p) + len(n)" if limit is None else f"least(len(a) + len(p) + len(n), {limit})"
    return f"""
samples AS (
  SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM (
    SELECT * EXCLUDE (a, p, n), {end} AS len,
      list_concat(list_concat(a, p), n)[1:{end}] AS ids,
      list_concat(list_concat(list_transform(a, lambda x: 0), list_transform(p, lambda x: 1)),
                  list_transform(n, lambda x: 2))[1:{end}] AS labels,
      list_concat(list_concat(range(len(a)), range(len(p))), range(len(n)))[1:{end}] AS places
    FROM tokenized {where})
)"""


def greedy(length: int, cap: int | None) -> str:
    """The sequential rule row by row: walk holds the open pack after each sample."""
    cap = 10**6 if cap is None else cap
    fits = f"w.held > 0 AND w.used + s.len <= {length} AND w.held + 1 <= {cap}"
    return f"""
sizes AS (SELECT rn, len, len > {length} AS big FROM samples),
walk AS (
  SELECT 0::BIGINT AS rn, 0::BIGINT AS used, 0::BIGINT AS held, -1::BIGINT AS p
  UNION ALL
  SELECT s.rn,
    CASE WHEN s.big THEN w.used WHEN {fits} THEN w.used + s.len ELSE s.len END,
    CASE WHEN s.big THEN w.held WHEN {fits} THEN w.held + 1 ELSE 1 END,
    CASE WHEN s.big OR ({fits}) THEN w.p ELSE w.p + 1 END
  FROM walk w JOIN sizes s ON s.rn = w.rn + 1
),
{numbered_packs("walk.held - 1", "walk.p", "JOIN walk USING (rn)")}"""


def numbered_packs(ordinal: str, pack: str, join: str) -> str:
    """Packs numbered as they are finished; oversize samples overtake the open pack."""
    return f"""placed AS (
  SELECT sizes.rn, sizes.big, {pack} AS p, {ordinal} AS ord,
    count(*) FILTER (WHERE sizes.big) OVER (ORDER BY sizes.rn ROWS UNBOUNDED PRECEDING)
      - CASE WHEN sizes.big THEN 1 ELSE 0 END AS over_before
  FROM sizes {join}
),
first_rows AS (SELECT p, min(rn) AS rn FROM placed WHERE NOT big GROUP BY p),
closing AS (
  SELECT f.p, coalesce(c.over_before, (SELECT count(*) FROM sizes WHERE big)) AS over_before
  FROM (SELECT p, lead(rn) OVER (ORDER BY p) AS rn FROM first_rows) f LEFT JOIN placed c ON c.rn = f.rn
),
assigned AS (
  SELECT samples.*,
    CASE WHEN big THEN placed.over_before + greatest(placed.p, 0)
         ELSE placed.p + closing.over_before END::BIGINT AS pack_id,
    CASE WHEN big THEN 0 ELSE ord END::INTEGER AS sample_ord
  FROM samples JOIN placed USING (rn) LEFT JOIN closing ON closing.p = placed.p
)"""


def packed(length: int, slots: int = 3, pad: int = 0) -> str:
    """Padded rows from assigned samples."""
    return f"""
joined AS (
  SELECT pack_id, count(*)::INTEGER AS num_segments,
    flatten(list(ids[1:{length}] ORDER BY sample_ord)) AS ids,
    flatten(list(list_transform(labels[1:{length}], lambda k: sample_ord * {slots} + k) ORDER BY sample_ord)) AS segments,
    flatten(list(places[1:{length}] ORDER BY sample_ord)) AS places
  FROM assigned GROUP BY pack_id
),
packs AS (
  SELECT pack_id, num_segments, len(ids) AS used,
    list_resize(ids, {length}, {pad}) AS input_ids,
    list_resize(list_transform(ids, lambda x: 1), {length}, 0) AS attention_mask,
    list_resize(segments, {length}, -1) AS segment_ids,
    list_resize(places, {length}, 0) AS position_ids
  FROM joined
)"""


def chat_ctes(config=CHAT, *more: str) -> str:
    return ctes(
        CHAT_TRIPLETS, USABLE, tokenized("conv_id, turn"), limited("conv_id, turn", config.max_sample_length),
        greedy(config.seq_length, config.max_samples), packed(config.seq_length), *more,
    )


def doc_ctes(*more: str) -> str:
    return ctes(
        DOC_TRIPLETS, USABLE, tokenized("doc_id, source"), limited("doc_id", DOCS.max_sample_length),
        greedy(DOCS.seq_length, DOCS.max_samples), packed(DOCS.seq_length), *more,
    )


PACK_TEXT = "pack_id, num_segments, " + ", ".join(
    f"{text_of(c)} AS {c}" for c in ("input_ids", "attention_mask", "segment_ids", "position_ids")
)

# --- triplets -----------------------------------------------------------------------------------

ORACLES["triplet_build"] = ctes(CHAT_TRIPLETS) + " SELECT conv_id, turn, anchor, positive, negative FROM triplets"
ORACLES["triplet_filter"] = (
    ctes(CHAT_TRIPLETS, USABLE) + " SELECT conv_id, turn, md5(anchor || positive || negative) AS texts FROM usable"
)
_REJECT = """
reasons AS (
  SELECT *, CASE WHEN quality = 1 THEN positive END AS second,
    CASE WHEN coalesce(anchor, '') = '' OR coalesce(positive, '') = ''
           OR (negative IS NULL AND second IS NULL) THEN 'empty_field'
         WHEN negative IS NULL OR second IS NULL THEN 'negative_count' END AS reject_reason
  FROM triplets
)"""
ORACLES["triplet_rejects"] = (
    ctes(DOC_TRIPLETS, _REJECT) + " SELECT doc_id, reject_reason FROM reasons WHERE reject_reason IS NOT NULL"
)
ORACLES["triplet_two_negatives"] = ctes(DOC_TRIPLETS, _REJECT) + """
SELECT doc_id, concat_ws(',', length(anchor) + 1, length(positive) + 1, length(negative) + 1, length(second) + 1) AS slot_sizes
FROM reasons WHERE reject_reason IS NULL"""
ORACLES["tokenize_words"] = f"""
SELECT doc_id, len(w)::INTEGER AS n_words, md5(array_to_string(w, ' ')) AS words
FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents)"""
ORACLES["tokenize_codepoints"] = f"""
SELECT doc_id, len(t)::INTEGER AS n_points, {text_of("t")} AS points
FROM (SELECT doc_id, {POINTS.format("text")} AS t FROM documents)"""
ORACLES["slot_label"] = ctes(CHAT_TRIPLETS, USABLE, tokenized("conv_id, turn"), limited("conv_id, turn", None)) + f"""
SELECT conv_id, turn, {text_of("ids")} AS input_ids, {text_of("labels")} AS triplet_type FROM samples"""
ORACLES["sample_lengths"] = ctes(CHAT_TRIPLETS, USABLE) + """
SELECT conv_id, turn, (length(anchor) + 1)::INTEGER AS anchor_tokens, (length(positive) + 1)::INTEGER AS positive_tokens,
  (length(negative) + 1)::INTEGER AS negative_tokens FROM usable"""
ORACLES["length_filter_truncate"] = ctes(
    CHAT_TRIPLETS, USABLE, tokenized("conv_id, turn"), limited("conv_id, turn", CHAT.max_sample_length)
) + f""" SELECT conv_id, turn, len::INTEGER AS n_tokens, {text_of("ids")} AS input_ids, {text_of("labels")} AS triplet_type FROM samples"""

# --- vocabulary ---------------------------------------------------------------------------------


def vocabulary(table: str, name: str, first: int) -> str:
    return f"""
{name}_words AS (SELECT unnest({WORDS.format("text")}) AS token FROM {table}),
{name} AS (
  SELECT token, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, encode(token)) - 1 + {first})::INTEGER AS token_id
  FROM {name}_words GROUP BY token
)"""


ORACLES["vocab_build"] = (
    ctes(vocabulary("documents", "vocab", FIRST_WORD_ID)) + " SELECT token, n, token_id FROM vocab"
)
ORACLES["vocab_encode"] = ctes(vocabulary("documents", "vocab", FIRST_WORD_ID)) + f""",
spelled AS (SELECT conv_id || '-' || turn AS key, {WORDS.format("text")} AS w FROM conversations),
each AS (SELECT key, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM spelled),
ids AS (
  SELECT key, list(coalesce(token_id, 0) ORDER BY i) AS ids
  FROM each LEFT JOIN vocab USING (token) GROUP BY key
)
SELECT key, len(w)::INTEGER AS n_tokens, md5(coalesce(array_to_string(ids, ','), '')) AS ids
FROM spelled LEFT JOIN ids USING (key)"""
ORACLES["vocab_encode_by_join"] = ORACLES["vocab_encode"]
_EXTENDED = vocabulary("benchmark", "base", 0) + f""",
chat_words AS (SELECT DISTINCT unnest({WORDS.format("text")}) AS token FROM conversations),
extended AS (
  SELECT token, token_id FROM base
  UNION ALL
  SELECT token, (row_number() OVER (ORDER BY encode(token)) - 1 + (SELECT count(*) FROM base))::INTEGER
  FROM chat_words WHERE token NOT IN (SELECT token FROM base)
)"""
ORACLES["vocab_extend"] = ctes(_EXTENDED) + " SELECT token, token_id FROM extended"
_DIMS = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"
ORACLES["vocab_joint_extend"] = ctes(_EXTENDED) + f"""
SELECT token, token_id, millionths
FROM extended CROSS JOIN (
  SELECT string_agg(round(x * 1000000)::BIGINT::VARCHAR, ',' ORDER BY dim) AS millionths FROM (
    SELECT dim, avg(x) AS x FROM base JOIN ({_DIMS}) ON vec_id = token_id % (SELECT count(*) FROM embeddings) GROUP BY dim))
WHERE token_id >= (SELECT count(*) FROM base)"""
_NEW_IDS = "(SELECT (SELECT count(*) FROM embeddings) + row_number() OVER () - 1 AS token_id FROM benchmark)"
ORACLES["vocab_vectors_average"] = f"""
SELECT token_id::INTEGER AS token_id, dim::INTEGER AS dim, round(x, 6) AS x
FROM {_NEW_IDS} CROSS JOIN (SELECT dim, avg(x) AS x FROM ({_DIMS}) GROUP BY dim)"""
ORACLES["vocab_vectors_zeros"] = f"""
SELECT token_id::INTEGER AS token_id, dim::INTEGER AS dim, 0.0::DOUBLE AS x
FROM {_NEW_IDS} CROSS JOIN (SELECT unnest(range({VECTOR_SIZE})) AS dim)"""


def _uniform(stream: int) -> str:
    return f"(('0x' || md5(concat_ws(':', {RANDOM_SEED}, token_id, dim, {stream}))[1:12])::BIGINT + 0.5) / 281474976710656.0::DOUBLE"


ORACLES["vocab_vectors_random"] = f"""
SELECT token_id::INTEGER AS token_id, dim::INTEGER AS dim,
  round(sqrt(-2.0 * ln({_uniform(0)})) * cos(2.0 * pi() * {_uniform(1)}) * 0.02, 6) AS x
FROM {_NEW_IDS} CROSS JOIN (SELECT unnest(range({VECTOR_SIZE})) AS dim)"""

# --- packing ------------------------------------------------------------------------------------

_ASSIGNED = " SELECT conv_id, turn, len::INTEGER AS n_tokens, pack_id, sample_ord FROM assigned"
ORACLES["pack_assign"] = chat_ctes(CHAT) + _ASSIGNED
ORACLES["pack_assign_capped"] = chat_ctes(CHAT_CAPPED) + _ASSIGNED
ORACLES["pack_oversize"] = (
    doc_ctes() + " SELECT doc_id, len::INTEGER AS n_tokens, pack_id, sample_ord FROM assigned"
)


def order_packs() -> str:
    """Greedy packing by following pointers from pack start to pack start (no oversize samples)."""
    length, cap = ORDERS.seq_length, ORDERS.max_samples
    return f"""
samples AS (SELECT o_orderkey AS pos, (o_custkey % 500 + 1)::INTEGER AS len,
  row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders),
totals AS (SELECT rn, coalesce(sum(len) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM samples
  UNION ALL SELECT count(*), sum(len) FROM samples),
follow AS (
  SELECT a.rn, least(b.rn, a.rn + {cap}) AS nxt
  FROM totals a ASOF JOIN totals b ON a.before + {length} >= b.before
  WHERE a.rn < (SELECT count(*) FROM samples)
),
pointers AS MATERIALIZED (SELECT list(nxt ORDER BY rn) AS nxt, count(*) AS n FROM follow),
walk AS (
  SELECT 0::BIGINT AS rn, 0::BIGINT AS p
  UNION ALL
  SELECT pointers.nxt[walk.rn + 1], p + 1 FROM walk, pointers WHERE pointers.nxt[walk.rn + 1] < pointers.n
),
assigned AS (
  SELECT s.pos, s.len AS n_tokens, w.p AS pack_id, (s.rn - w.rn)::INTEGER AS sample_ord
  FROM samples s ASOF JOIN walk w ON s.rn >= w.rn
)"""


ORACLES["pack_assign_orders"] = ctes(order_packs()) + " SELECT * FROM assigned"
ORACLES["pack_rows"] = chat_ctes(CHAT_CAPPED) + f" SELECT {PACK_TEXT} FROM packs"
ORACLES["pack_rows_oversize"] = doc_ctes() + f" SELECT {PACK_TEXT} FROM packs"
_WORD_LENGTH = 1024
ORACLES["pack_rows_words"] = ctes(
    vocabulary("conversations", "vocab", FIRST_WORD_ID),
    CHAT_TRIPLETS,
    USABLE,
    f"""
spelled AS (
  SELECT conv_id, turn, unnest([0, 1, 2]) AS slot,
    unnest([{WORDS.format("anchor")}, {WORDS.format("positive")}, {WORDS.format("negative")}]) AS w
  FROM usable
),
each AS (SELECT conv_id, turn, slot, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM spelled),
coded AS (
  SELECT conv_id, turn, slot, list(token_id ORDER BY i) AS ids FROM each JOIN vocab USING (token) GROUP BY ALL
),
ended AS (
  SELECT conv_id, turn, slot, list_append(coalesce(ids, []), {EOS}) AS ids
  FROM spelled LEFT JOIN coded USING (conv_id, turn, slot)
),
tokenized AS (
  SELECT conv_id, turn, any_value(ids) FILTER (WHERE slot = 0) AS a, any_value(ids) FILTER (WHERE slot = 1) AS p,
    any_value(ids) FILTER (WHERE slot = 2) AS n
  FROM ended GROUP BY conv_id, turn
)""",
    limited("conv_id, turn", min(CHAT_CAPPED.max_sample_length, _WORD_LENGTH)),
    greedy(_WORD_LENGTH, CHAT_CAPPED.max_samples),
    packed(_WORD_LENGTH),
) + f" SELECT {PACK_TEXT} FROM packs"
ORACLES["pack_sources"] = doc_ctes() + """
SELECT pack_id, string_agg(source, ',' ORDER BY sample_ord) AS source_ids FROM assigned GROUP BY pack_id"""
ORACLES["pack_fill_rate"] = chat_ctes(CHAT_CAPPED) + f"""
SELECT pack_id, num_segments, used::INTEGER AS used_tokens, round(used / {CHAT_CAPPED.seq_length}, 6) AS fill_rate FROM packs"""


def by_strategy(state: str, start: str, step: str, window: int = WINDOW_ROWS) -> str:
    """Chat samples packed window by window; ``walk`` carries the open packs of each window."""
    config = CHAT_CAPPED
    return ctes(
        CHAT_TRIPLETS,
        USABLE,
        tokenized("conv_id, turn"),
        f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM tokenized),
kept AS (
  SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS number, least(len(a) + len(p) + len(n), {config.max_sample_length})::BIGINT AS len
  FROM numbered WHERE len(a) + len(p) < {config.max_sample_length}
),
sizes AS MATERIALIZED (
  SELECT pos, number // {window} AS win, row_number() OVER (PARTITION BY number // {window} ORDER BY number) AS rn, len FROM kept
),
walk AS (
  SELECT DISTINCT win, 0::BIGINT AS rn, {start}, 0::BIGINT AS opened, -1::BIGINT AS bin, 0::BIGINT AS ord FROM sizes
  UNION ALL
  SELECT win, rn, {step} FROM (
    SELECT s.win, s.rn, s.len, {state}, w.opened,
      [CASE WHEN w.rooms[i] >= s.len AND w.helds[i] < {config.sample_cap} THEN w.rooms[i] END FOR i IN range(1, len(w.rooms) + 1)] AS fitting
    FROM walk w JOIN sizes s ON s.win = w.win AND s.rn = w.rn + 1
  )
)""",
    ) + f"""
SELECT pos, win * {window} + bin AS pack_id, ord::INTEGER AS sample_ord FROM sizes JOIN walk USING (win, rn)"""


def _put(values: str, at: str, value: str) -> str:
    return f"list_concat(list_concat({values}[1:{at} - 1], [{value}]), {values}[{at} + 1:])"


_FIRST = "list_position([f IS NOT NULL FOR f IN fitting], true)"
_ROOM = f"{CHAT_CAPPED.seq_length} - len"
_FIRST_FIT = (
    "w.rooms, w.helds",
    "[]::BIGINT[] AS rooms, []::BIGINT[] AS helds",
    f"""CASE WHEN coalesce({_FIRST}, 0) = 0 THEN list_append(rooms, {_ROOM}) ELSE {_put("rooms", _FIRST, f"rooms[{_FIRST}] - len")} END,
    CASE WHEN coalesce({_FIRST}, 0) = 0 THEN list_append(helds, 1) ELSE {_put("helds", _FIRST, f"helds[{_FIRST}] + 1")} END,
    CASE WHEN coalesce({_FIRST}, 0) = 0 THEN opened + 1 ELSE opened END,
    CASE WHEN coalesce({_FIRST}, 0) = 0 THEN opened ELSE {_FIRST} - 1 END,
    CASE WHEN coalesce({_FIRST}, 0) = 0 THEN 0 ELSE helds[{_FIRST}] END""",
)
ORACLES["pack_first_fit"] = by_strategy(*_FIRST_FIT)
ORACLES["pack_first_fit_windows"] = by_strategy(*_FIRST_FIT, SMALL_WINDOW)
_BEST = "list_position(fitting, list_min(fitting))"
_FULLEST = "list_position(rooms, list_min(rooms))"


def _pooled(values: str, new: str, changed: str) -> str:
    """The pool's packs after a sample: one changed, or a new one in place of the fullest."""
    room_left = f"CASE WHEN len(rooms) < {POOL_PACKS} THEN {values} ELSE list_concat({values}[1:{_FULLEST} - 1], {values}[{_FULLEST} + 1:]) END"
    return f"CASE WHEN list_min(fitting) IS NULL THEN list_append({room_left}, {new}) ELSE {_put(values, _BEST, changed)} END"


_POOL = (
    "w.rooms, w.helds, w.bins",
    "[]::BIGINT[] AS rooms, []::BIGINT[] AS helds, []::BIGINT[] AS bins",
    f"""{_pooled("rooms", _ROOM, f"rooms[{_BEST}] - len")}, {_pooled("helds", "1", f"helds[{_BEST}] + 1")},
    {_pooled("bins", "opened", f"bins[{_BEST}]")},
    CASE WHEN list_min(fitting) IS NULL THEN opened + 1 ELSE opened END,
    CASE WHEN list_min(fitting) IS NULL THEN opened ELSE bins[{_BEST}] END,
    CASE WHEN list_min(fitting) IS NULL THEN 0 ELSE helds[{_BEST}] END""",
)
ORACLES["pack_pool"] = by_strategy(*_POOL)
ORACLES["pack_pool_windows"] = by_strategy(*_POOL, SMALL_WINDOW)
ORACLES["packed_table"] = chat_ctes(CHAT_CAPPED) + """
SELECT num_segments, count(*) AS n_packs, sum(used)::BIGINT AS n_tokens FROM packs GROUP BY num_segments"""

# --- order and batches --------------------------------------------------------------------------

_PACK_IDS = "(SELECT DISTINCT pack_id FROM assigned)"
_KEY = f"md5('{SEED}:' || pack_id)"
ORACLES["shuffle_order"] = ctes(order_packs()) + f"""
SELECT pack_id, row_number() OVER (ORDER BY {_KEY}, pack_id) - 1 AS pack_seq FROM {_PACK_IDS}"""
ORACLES["shuffle_buffer"] = ctes(order_packs()) + f"""
SELECT pack_id, row_number() OVER (ORDER BY pack_id // 100, {_KEY}, pack_id) - 1 AS pack_seq FROM {_PACK_IDS}"""

ORACLES["pack_first_fit_levels"] = "SELECT o_orderkey AS pos, o_custkey % 500 + 1 AS n_tokens, true AS fits FROM orders"
ORACLES["shuffle_reservoir"] = ctes(order_packs()) + f""",
drawn AS (
  SELECT pack_id, CASE WHEN pack_id < {RESERVOIR} THEN pack_id
    ELSE ('0x' || md5('{SEED}:place:' || pack_id)[1:15])::BIGINT % {RESERVOIR} END AS place FROM {_PACK_IDS}),
put_out AS (SELECT pack_id, lead(pack_id) OVER (PARTITION BY place ORDER BY pack_id) AS leaves FROM drawn)
SELECT pack_id, row_number() OVER (ORDER BY leaves NULLS LAST, CASE WHEN leaves IS NULL THEN md5('{SEED}:rest:' || pack_id) END, pack_id) - 1 AS pack_seq
FROM put_out"""


def batched(order: str, drop_last: bool) -> str:
    keep = f"WHERE pack_seq // {BATCH} < (SELECT count(*) FROM packs) // {BATCH}" if drop_last else ""
    return f"""
batched AS (
  SELECT *, pack_seq // {BATCH} AS batch_id
  FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pack_seq FROM packs) {keep}
)"""


ORACLES["batch_assign"] = chat_ctes(CHAT_CAPPED, batched(f"{_KEY}, pack_id", True)) + """
SELECT pack_id, num_segments, pack_seq, batch_id FROM batched"""
ORACLES["batch_keep_partial"] = chat_ctes(CHAT_CAPPED, batched("pack_id", False)) + """
SELECT pack_id, num_segments, pack_seq, batch_id FROM batched"""


def collated(length: int, keep_end: bool) -> str:
    def field(name: str, pad: int) -> str:
        cut = f"{name}[greatest(len({name}) - {length}, 0) + 1:]" if keep_end else f"{name}[1:{length}]"
        rows = f"list(list_resize({cut}, {length}, {pad}) ORDER BY pack_seq)"
        return f"{text_of(f'flatten({rows})')} AS {name}"

    fields = [field(c, -1 if c == "segment_ids" else 0) for c in ("input_ids", "attention_mask", "segment_ids", "position_ids")]
    return chat_ctes(CHAT_CAPPED, batched("pack_id", True)) + f"""
SELECT batch_id, count(*)::INTEGER AS n_rows, {", ".join(fields)},
  {text_of("list(num_segments ORDER BY pack_seq)")} AS num_segments
FROM batched GROUP BY batch_id"""


ORACLES["collate_keep_end"] = collated(5000, True)
ORACLES["collate_keep_start"] = collated(5000, False)
ORACLES["collate_pad"] = collated(7000, True)

# --- unpacking ----------------------------------------------------------------------------------

TOKENS = """
tokens AS (
  SELECT pack_id, unnest(segment_ids) AS segment_id, unnest(input_ids) AS input_id, unnest(attention_mask) AS attended,
    unnest(position_ids) AS position_id, generate_subscripts(segment_ids, 1) - 1 AS pos
  FROM packs
),
decoded AS (
  SELECT *, CASE WHEN segment_id >= 0 THEN segment_id // 3 ELSE -1 END AS sample_id,
    CASE WHEN segment_id >= 0 THEN segment_id % 3 ELSE -1 END AS slot
  FROM tokens
)"""


def bounds(masked: bool) -> str:
    end = "max(pos) FILTER (WHERE attended = 1) + 1" if masked else "count(*)"
    return f"""
ends AS (SELECT pack_id, {end} AS valid FROM decoded GROUP BY pack_id),
starts AS (
  SELECT pack_id, pos AS start, valid FROM (
    SELECT pack_id, pos, sample_id, valid, lag(sample_id, 1, -1) OVER (PARTITION BY pack_id ORDER BY pos) AS before
    FROM decoded JOIN ends USING (pack_id) WHERE pos < valid
  ) WHERE sample_id >= 0 AND sample_id <> before
),
bounds AS (
  SELECT pack_id, start, lead(start, 1, valid) OVER (PARTITION BY pack_id ORDER BY start) - start AS length,
    row_number() OVER (PARTITION BY pack_id ORDER BY start) - 1 AS sample_ord
  FROM starts
)"""


_BOUND_LISTS = """count(*)::INTEGER AS num_samples,
  string_agg(start, ',' ORDER BY {0}start) AS sample_starts, string_agg(length, ',' ORDER BY {0}start) AS sample_lengths"""
ORACLES["segment_decode"] = chat_ctes(CHAT_CAPPED, TOKENS) + """
SELECT pack_id, sample_id::INTEGER AS sample_id, slot::INTEGER AS slot, count(*) AS n, min(pos)::INTEGER AS first_pos,
  max(pos)::INTEGER AS last_pos FROM decoded GROUP BY pack_id, sample_id, slot"""
ORACLES["sample_bounds"] = chat_ctes(CHAT_CAPPED, TOKENS, bounds(True)) + f"""
SELECT pack_id, {_BOUND_LISTS.format("")} FROM bounds GROUP BY pack_id"""
ORACLES["sample_bounds_unmasked"] = chat_ctes(CHAT_CAPPED, TOKENS, bounds(False)) + f"""
SELECT pack_id, {_BOUND_LISTS.format("")} FROM bounds GROUP BY pack_id"""
ORACLES["batch_sample_info"] = chat_ctes(CHAT_CAPPED, TOKENS, bounds(True)) + f"""
SELECT pack_id // {BATCH} AS batch_id, {_BOUND_LISTS.format("pack_id, ")} FROM bounds GROUP BY pack_id // {BATCH}"""
ORACLES["split_samples"] = chat_ctes(CHAT_CAPPED, TOKENS, bounds(True)) + f"""
SELECT pack_id, sample_ord::INTEGER AS sample_ord, start::INTEGER AS start, length::INTEGER AS length,
  {text_of("input_ids[start + 1:start + length]")} AS input_ids,
  {text_of("segment_ids[start + 1:start + length]")} AS segment_ids
FROM bounds JOIN packs USING (pack_id)"""

# --- quality ------------------------------------------------------------------------------------

ORACLES["position_check"] = chat_ctes(CHAT_CAPPED, TOKENS) + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pack_id, segment_id, attended ORDER BY pos) - 1 AS expected,
    CASE WHEN segment_id >= 0 THEN pos ELSE 0 END AS running
  FROM tokens
)
SELECT pack_id,
  count(*) FILTER (WHERE CASE WHEN attended = 1 THEN segment_id >= 0 AND position_id <> expected ELSE position_id <> 0 END) AS n_errors,
  count(*) FILTER (WHERE CASE WHEN attended = 1 THEN segment_id >= 0 AND running <> expected ELSE running <> 0 END) AS n_faulty
FROM ranked GROUP BY pack_id"""
ORACLES["sample_id_check"] = chat_ctes(CHAT_CAPPED, TOKENS, bounds(False)) + """,
inside AS (
  SELECT b.pack_id, b.sample_ord, count(DISTINCT d.sample_id) AS n, min(d.sample_id) AS id
  FROM bounds b JOIN decoded d ON d.pack_id = b.pack_id AND d.pos >= b.start AND d.pos < b.start + b.length AND d.sample_id >= 0
  GROUP BY ALL
),
near AS (SELECT *, lag(id) OVER (PARTITION BY pack_id ORDER BY sample_ord) AS before FROM inside)
SELECT pack_id, count(*)::INTEGER AS n_samples, count(*) FILTER (WHERE n > 1)::INTEGER AS mixed_samples,
  count(*) FILTER (WHERE id = before)::INTEGER AS equal_neighbours FROM near GROUP BY pack_id"""
ORACLES["slot_order_check"] = chat_ctes(CHAT_CAPPED, TOKENS) + """,
per_slot AS (
  SELECT pack_id, sample_id, slot, min(pos) AS low, max(pos) AS high, count(*) AS n
  FROM decoded WHERE segment_id >= 0 GROUP BY ALL
),
stepped AS (
  SELECT *, lag(high) OVER w AS before, lag(slot) OVER w AS slot_before
  FROM per_slot WINDOW w AS (PARTITION BY pack_id, sample_id ORDER BY slot)
)
SELECT pack_id, sample_id::INTEGER AS sample_id, count(*) FILTER (WHERE slot - slot_before > 1) AS skipped_steps,
  3 - count(*) AS missing_slots, count(*) FILTER (WHERE before >= low) AS overlapping_slots,
  count(*) FILTER (WHERE high - low + 1 <> n) AS broken_slots
FROM stepped GROUP BY pack_id, sample_id"""
ORACLES["overlap_check"] = chat_ctes(CHAT_CAPPED, TOKENS, bounds(True)) + """,
near AS (SELECT *, lead(start) OVER (PARTITION BY pack_id ORDER BY start) AS following FROM bounds)
SELECT pack_id, count(*)::INTEGER AS n_samples, count(*) FILTER (WHERE start + length > following)::INTEGER AS overlaps,
  count(*) = any_value(num_segments) AS counts_agree
FROM near JOIN packs USING (pack_id) GROUP BY pack_id"""
ORACLES["split_check"] = chat_ctes(CHAT_CAPPED, TOKENS, bounds(True)) + """,
split AS (SELECT pack_id, sample_ord, input_ids[start + 1:start + length] AS got FROM bounds JOIN packs USING (pack_id))
SELECT (SELECT count(*) FROM assigned) AS n_samples,
  (SELECT count(*) FROM assigned a FULL JOIN split s ON s.pack_id = a.pack_id AND s.sample_ord = a.sample_ord
   WHERE s.got IS DISTINCT FROM a.ids) AS n_mismatches"""
ORACLES["missing_ids"] = chat_ctes(CHAT) + """
SELECT DISTINCT conv_id, 'missing' AS problem FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM samples)"""
ORACLES["coverage_check"] = doc_ctes() + """,
counts AS (SELECT (SELECT count(*) FROM samples) AS n_seen, (SELECT count(*) FROM documents) AS n_expected)
SELECT n_seen, n_expected, round(n_seen / n_expected, 6) AS coverage,
  n_seen / n_expected BETWEEN 0.90 AND 1.10 AS accepted FROM counts"""
ORACLES["pack_totals"] = chat_ctes(CHAT_CAPPED) + """
SELECT count(*) AS n_packs, sum(num_segments)::BIGINT AS n_samples,
  sum(len(list_filter(input_ids, lambda x: x > 0)))::BIGINT AS n_tokens, max(num_segments) AS max_samples_per_pack FROM packs"""
ORACLES["sample_cap_check"] = chat_ctes(CHAT) + " SELECT pack_id, num_segments FROM packs WHERE num_segments > 5"
ORACLES["first_token_overlap"] = ctes(
    CHAT_TRIPLETS, USABLE, tokenized("conv_id, turn"), limited("conv_id, turn", CHAT.max_sample_length),
    greedy(CHAT.seq_length, CHAT.max_samples),
    "uncapped AS (SELECT DISTINCT ids[1] AS first_token FROM assigned WHERE sample_ord = 0)",
) + ", " + (
    greedy(CHAT_CAPPED.seq_length, CHAT_CAPPED.max_samples)
    .replace("sizes", "sizes2").replace("walk", "walk2").replace("placed", "placed2")
    .replace("first_rows", "first_rows2").replace("closing", "closing2").replace("assigned AS", "assigned2 AS")
) + """
SELECT first_token::INTEGER AS first_token FROM uncapped
WHERE first_token IN (SELECT ids[1] FROM assigned2 WHERE sample_ord = 0)"""


def _generated(field: str) -> str:
    return f"""md5(printf('{field.upper()}_%06d: ', doc_id) || coalesce(CASE doc_id % 3 WHEN 0 THEN concat_ws(' ', lang, source)
  WHEN 1 THEN text ELSE repeat(text, 5) END, '')) AS {field}"""


ORACLES["generated_triplets"] = (
    "SELECT doc_id AS sample_id, " + ", ".join(map(_generated, ("anchor", "positive", "negative"))) + " FROM documents"
)

# --- files, positions and resuming --------------------------------------------------------------

_LINES = "lines AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM triplets)"
_OUTCOME = f"""
outcomes AS (
  SELECT doc_id, length(anchor) + length(positive) + length(negative) + 3 AS len, CASE
    WHEN doc_id % 10 = 7 THEN 'corrupt_line'
    WHEN coalesce(anchor, '') = '' OR coalesce(positive, '') = '' THEN 'empty_field'
    WHEN doc_id % 10 = 5 THEN 'null_negative'
    WHEN coalesce(negative, '') = '' THEN 'empty_field'
    WHEN length(anchor) + length(positive) + 2 >= {CHAT.max_sample_length} THEN 'too_long'
    ELSE 'sample' END AS outcome
  FROM triplets
)"""
ORACLES["row_outcomes"] = ctes(DOC_TRIPLETS, _OUTCOME) + " SELECT outcome, count(*) AS n_rows FROM outcomes GROUP BY outcome"
ORACLES["resume_shuffled"] = ctes(DOC_TRIPLETS, _OUTCOME) + """
SELECT doc_id, 1::BIGINT AS n_used FROM outcomes WHERE outcome = 'sample'"""
ORACLES["recursive_discovery"] = "SELECT doc_id, md5(text) AS anchor, '' AS negative FROM documents"
ORACLES["saved_table"] = "SELECT lang, count(*) AS n_rows FROM documents GROUP BY lang"
ORACLES["latest_checkpoint"] = """
SELECT 0::INTEGER AS shard_index, last AS row_index FROM (
  SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type
) ORDER BY n DESC, 'step-' || n || '-' || event_type DESC LIMIT 1"""
ORACLES["jsonl_positions"] = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents"
ORACLES["jsonl_triplets"] = ctes(DOC_TRIPLETS, _LINES) + """,
read AS (
  SELECT doc_id, pos, anchor, positive, CASE doc_id % 3 WHEN 0 THEN negative WHEN 1 THEN negative ELSE '' END AS negative,
    CASE WHEN doc_id % 3 = 0 THEN coalesce(negative, '') <> '' ELSE true END AS has_negative
  FROM lines
)
SELECT doc_id, pos, md5(anchor || positive) AS texts, negative FROM read
WHERE coalesce(anchor, '') <> '' AND coalesce(positive, '') <> '' AND has_negative"""
ORACLES["shard_list"] = 'SELECT count(*) AS n_rows, count(*) AS "end" FROM documents'
SHARDED = """
sharded AS (
  SELECT doc_id, lang, source, length(text) AS len, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS shard_index,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index,
    row_number() OVER (ORDER BY source, doc_id) AS rn
  FROM documents
)"""
ORACLES["resume_explicit"] = ctes(SHARDED) + """
SELECT doc_id, shard_index, row_index FROM sharded WHERE shard_index > 9 OR (shard_index = 9 AND row_index >= 5)"""
ORACLES["saved_states"] = ctes(SHARDED) + """
SELECT source AS name, shard_index, count(*) AS row_index, (min(rn) - 1)::INTEGER AS step, 1::INTEGER AS epoch
FROM sharded GROUP BY source, shard_index"""
ORACLES["state_history"] = """
SELECT step - 1 AS entry, count * step // 5 AS row_index, step::INTEGER AS step, step = 5 AS newest
FROM (SELECT count(*) AS count FROM documents), range(1, 6) AS r(step)"""
ORACLES["stream_then_batch"] = """
SELECT doc_id, CASE WHEN pos < n // 3 THEN 'stream' ELSE 'batch' END AS "by"
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"""
ORACLES["seek_open_at_row"] = """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) WHERE pos >= n // 2"""
ORACLES["undeclared_fields"] = "SELECT doc_id, lang, n_chars, source AS tag FROM documents"
ORACLES["sample_positions"] = ctes(SHARDED) + " SELECT doc_id, shard_index, row_index FROM sharded"
ORACLES["shard_count"] = ctes(SHARDED) + " SELECT lang, count(DISTINCT shard_index) AS n_shards FROM sharded GROUP BY lang"
ORACLES["shard_select"] = ctes(SHARDED) + """
SELECT doc_id, shard_index, row_index FROM sharded WHERE shard_index IN (0, 3, 11)"""
ORACLES["shard_open_at_row"] = ctes(SHARDED) + """
SELECT doc_id, row_index FROM sharded WHERE source = 'src12' AND row_index >= 10"""
ORACLES["resume_filter"] = ctes(SHARDED) + f"""
SELECT doc_id, shard_index, row_index FROM sharded
WHERE shard_index > {RESUME.shard_index} OR (shard_index = {RESUME.shard_index} AND row_index >= {RESUME.row_index})"""
ORACLES["resume_shards"] = ctes(SHARDED) + f""",
shards AS (SELECT shard_index, source AS shard_name, count(*) AS n_rows, min(rn) - 1 AS first_pos FROM sharded GROUP BY ALL)
SELECT * FROM shards
WHERE shard_index > {RESUME.shard_index} OR (shard_index = {RESUME.shard_index} AND n_rows > {RESUME.row_index})"""
ORACLES["resume_progress"] = ctes(
    SHARDED, "samples AS (SELECT * FROM sharded)", greedy(4096, DOCS.max_samples)
) + """,
half AS (SELECT count(DISTINCT pack_id) // 2 AS n FROM assigned),
waiting AS (SELECT * FROM assigned WHERE pack_id >= (SELECT n FROM half) ORDER BY rn LIMIT 1)
SELECT shard_index, row_index,
  (SELECT count(*) FROM assigned a WHERE a.pack_id < (SELECT n FROM half) AND a.rn > waiting.rn) AS already_packed
FROM waiting"""
ORACLES["resume_last_read"] = ctes(SHARDED) + """
SELECT shard_index, row_index + 1 AS row_index FROM sharded ORDER BY rn DESC LIMIT 1"""
CHECKPOINTS = """
names AS (SELECT CASE WHEN event_type = 'error' THEN event_type ELSE event_type || '-' || event_id || '-v2' END AS name FROM events),
steps AS (SELECT name, CASE WHEN regexp_extract(name, '[0-9]+') <> '' THEN regexp_extract(name, '[0-9]+')::BIGINT ELSE -1 END AS checkpoint_step FROM names)"""
ORACLES["checkpoint_step"] = ctes(CHECKPOINTS) + " SELECT checkpoint_step, count(*) AS n FROM steps GROUP BY checkpoint_step"
ORACLES["resume_latest"] = ctes(CHECKPOINTS) + " SELECT checkpoint_step, name FROM steps ORDER BY checkpoint_step DESC LIMIT 1"

# --- vectors ------------------------------------------------------------------------------------



def token_table(samples: int) -> str:
    """Token vectors of the rows, and the last one of each segment of their first ``samples`` samples."""
    return f"""
token_rows AS (
  SELECT vec_id // {ROW_TOKENS} AS pack_id, (vec_id % {ROW_TOKENS})::INTEGER AS pos,
    CASE WHEN vec_id % {ROW_TOKENS} < 36 THEN ((vec_id % {ROW_TOKENS}) // 3)::INTEGER ELSE -1 END AS segment_id,
    vec_id % {ROW_TOKENS} < 38 AS attended, list_transform(embedding, lambda x: x::DOUBLE) AS vec
  FROM embeddings
),
pooled AS (
  SELECT pack_id, segment_id, (segment_id // 3)::INTEGER AS sample_id, (segment_id % 3)::INTEGER AS slot, arg_max(vec, pos) AS vec
  FROM token_rows WHERE attended AND segment_id >= 0 AND segment_id < {samples * 3} GROUP BY pack_id, segment_id
)"""


TOKEN_TABLE = token_table(MAX_SAMPLES)


def unit(vector: str) -> str:
    return f"""list_transform({vector}, lambda x: x / sqrt(greatest(list_dot_product({vector}, {vector}), 1e-8)))"""


def dims(source: str, keys: str, vector: str = "vec") -> str:
    return f"""
SELECT {keys}, dim::INTEGER AS dim, round(x, 6) AS x FROM (
  SELECT {keys}, unnest({vector}) AS x, generate_subscripts({vector}, 1) - 1 AS dim FROM {source})"""


ORACLES["last_token_pool"] = ctes(TOKEN_TABLE) + dims("pooled", "pack_id, sample_id, slot")
ORACLES["dropped_segments"] = ctes(TOKEN_TABLE) + f"""
SELECT pack_id, count(DISTINCT segment_id) AS dropped_segments FROM token_rows WHERE segment_id >= {MAX_SAMPLES * 3} GROUP BY pack_id"""
ORACLES["slot_grid"] = ctes(TOKEN_TABLE) + f""",
cells AS (SELECT pack_id, unnest(range(12)) AS segment_id FROM (SELECT DISTINCT pack_id FROM token_rows)),
grid AS (
  SELECT c.pack_id, (c.segment_id // 3)::INTEGER AS sample_id, (c.segment_id % 3)::INTEGER AS slot, p.vec IS NOT NULL AS present,
    coalesce(p.vec, list_transform(range({VECTOR_SIZE}), lambda i: 0.0::DOUBLE)) AS vec
  FROM cells c LEFT JOIN pooled p USING (pack_id, segment_id)
)""" + dims("grid", "pack_id, sample_id, slot, present")
ORACLES["last_position"] = ctes(TOKEN_TABLE) + f""",
last AS (
  SELECT pack_id, false AS masked, arg_max(vec, pos) AS vec FROM token_rows GROUP BY pack_id
  UNION ALL
  SELECT pack_id, true, arg_max(vec, pos) FROM token_rows WHERE attended GROUP BY pack_id
),
scaled AS (SELECT pack_id, masked, {unit("vec")} AS vec FROM last)""" + dims("scaled", "pack_id, masked")
_DOUBLES = "doubles AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"
ORACLES["l2_normalize"] = ctes(
    _DOUBLES,
    f"""scaled AS (SELECT vec_id, CASE WHEN label <> 0 THEN {unit("vec")} ELSE list_transform(vec, lambda x: 0.0::DOUBLE) END AS vec FROM doubles)""",
) + dims("scaled", "vec_id")
ORACLES["mean_pool"] = ctes(TOKEN_TABLE) + """,
each AS (SELECT pack_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM token_rows)
SELECT pack_id, dim::INTEGER AS dim, round(avg(x), 6) AS x FROM each GROUP BY pack_id, dim"""
ORACLES["cosine_pairs"] = ctes(_DOUBLES) + """
SELECT a.vec_id, round(CASE WHEN list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec) = 0 THEN 0
  ELSE list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) END, 6) AS similarity
FROM doubles a JOIN doubles b ON b.vec_id = a.vec_id + 1"""
ORACLES["vector_stats"] = ctes(TOKEN_TABLE) + """,
each AS (SELECT pack_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM token_rows WHERE attended)
SELECT pack_id, count(*) FILTER (WHERE dim = 0) AS n_valid, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
  round(min(x), 6) AS min, round(max(x), 6) AS max FROM each GROUP BY pack_id"""


def layer(source: str, name: str, size_in: int, size_out: int, gelu: bool) -> str:
    """One linear layer as a join of dimensions with weights."""
    y = "sum(x * cos(dim + 2 * j) / 8) + sin(j) / 10"
    out = f"""
{name}_linear AS (
  SELECT id, j AS dim, {y} AS x FROM {source}, (SELECT unnest(range({size_out})) AS j) WHERE dim < {size_in} GROUP BY id, j
)"""
    value = "0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x)))" if gelu else "x"
    return out + f""",
{name} AS (SELECT id, dim, {value} AS x FROM {name}_linear)"""


_EACH = f"each AS (SELECT vec_id AS id, dim, x FROM ({_DIMS}))"
_LAYER_ROWS = " SELECT id AS vec_id, dim::INTEGER AS dim, round(x, 6) AS x FROM "
ORACLES["project_linear"] = ctes(_EACH, layer("each", "out1", 64, 32, False)) + _LAYER_ROWS + "out1"
ORACLES["project_gelu"] = (
    ctes(_EACH, layer("each", "h1", 64, 32, True), layer("h1", "out1", 32, 20, False)) + _LAYER_ROWS + "out1"
)
ORACLES["project_identity"] = f"SELECT vec_id, dim::INTEGER AS dim, round(x, 6) AS x FROM ({_DIMS})"

# --- contrastive loss ---------------------------------------------------------------------------


def slot_vectors(num_negatives: int, batch: int | None) -> str:
    slots = 2 + num_negatives
    batch_id = "0" if batch is None else f"vec_id // {slots} // {batch}"
    return f"""
slot_vectors AS (
  SELECT ({batch_id})::BIGINT AS batch_id, (vec_id // {slots})::VARCHAR AS sample_key, (vec_id % {slots})::INTEGER AS slot,
    list_transform(embedding, lambda x: x::DOUBLE) AS vec
  FROM embeddings
)"""


def losses(temperatures: list[float], counts: list[int], num_negatives: int) -> str:
    """Every anchor of a batch against every negative of the batch; absent vectors score 0."""
    ts = ", ".join(f"{t}::DOUBLE" for t in temperatures)
    return f"""
valid AS (SELECT batch_id, sample_key, vec FROM slot_vectors WHERE slot = 0),
positives AS (
  SELECT v.batch_id, v.sample_key, coalesce(list_dot_product(v.vec, p.vec), 0) AS pos_sim
  FROM valid v LEFT JOIN slot_vectors p ON p.batch_id = v.batch_id AND p.sample_key = v.sample_key AND p.slot = 1
),
negatives AS (
  SELECT v.batch_id, v.sample_key, k.slot, n.vec
  FROM valid v CROSS JOIN (SELECT unnest(range(2, {2 + num_negatives})) AS slot) k
  LEFT JOIN slot_vectors n ON n.batch_id = v.batch_id AND n.sample_key = v.sample_key AND n.slot = k.slot
),
sims AS (
  SELECT v.batch_id, v.sample_key, n.slot, coalesce(list_dot_product(v.vec, n.vec), 0) AS sim
  FROM valid v JOIN negatives n ON n.batch_id = v.batch_id
),
grid AS (SELECT unnest([{ts}]) AS temperature),
counts AS (SELECT unnest({counts}) AS num_negatives),
tops AS (
  SELECT batch_id, sample_key, num_negatives, max(sim) AS neg_max, sum(sim) AS neg_sum
  FROM sims JOIN counts ON slot < 2 + num_negatives GROUP BY ALL
),
spread AS (
  SELECT s.batch_id, s.sample_key, t.num_negatives, g.temperature, any_value(t.neg_max) AS neg_max, any_value(t.neg_sum) AS neg_sum,
    any_value(t.neg_max) / g.temperature + ln(sum(exp((s.sim - t.neg_max) / g.temperature))) AS neg_lse
  FROM sims s JOIN tops t ON t.batch_id = s.batch_id AND t.sample_key = s.sample_key AND s.slot < 2 + t.num_negatives
  CROSS JOIN grid g GROUP BY s.batch_id, s.sample_key, t.num_negatives, g.temperature
),
anchor_loss AS (
  SELECT spread.*, pos_sim, greatest(pos_sim / temperature, neg_lse)
    + ln(exp(pos_sim / temperature - greatest(pos_sim / temperature, neg_lse)) + exp(neg_lse - greatest(pos_sim / temperature, neg_lse)))
    - pos_sim / temperature AS loss
  FROM spread JOIN positives USING (batch_id, sample_key)
),
metrics AS (
  SELECT batch_id, temperature, num_negatives::INTEGER AS num_negatives, round(sum(loss) / (count(*) + 1e-8), 6) AS loss,
    round(count(*) FILTER (WHERE pos_sim >= neg_max) / (count(*) + 1e-8), 6) AS accuracy, round(count(*) + 1e-8, 6) AS valid_samples,
    round(sum(pos_sim) / (count(*) + 1e-8), 6) AS pos_sim_mean,
    round(sum(neg_sum) / (count(*)::DOUBLE * count(*) * num_negatives + 1e-8), 6) AS neg_sim_mean
  FROM anchor_loss GROUP BY batch_id, temperature, num_negatives
)"""


_METRICS = "loss, accuracy, valid_samples, pos_sim_mean, neg_sim_mean"
ORACLES["infonce_loss"] = ctes(slot_vectors(1, LOSS_BATCH), losses([0.07], [1], 1)) + " SELECT batch_id, loss FROM metrics"
ORACLES["infonce_metrics"] = ctes(slot_vectors(1, 32), losses([0.07], [1], 1)) + f" SELECT batch_id, {_METRICS} FROM metrics"
ORACLES["infonce_blocks"] = ctes(slot_vectors(2, LOSS_BATCH), losses([0.07], [2], 2)) + f" SELECT batch_id, {_METRICS} FROM metrics"
ORACLES["infonce_temperature_sweep"] = (
    ctes(slot_vectors(1, 32), losses([0.05, 0.07, 0.1], [1], 1)) + f" SELECT batch_id, temperature, {_METRICS} FROM metrics"
)
ORACLES["infonce_negative_sweep"] = (
    ctes(slot_vectors(3, 32), losses([0.07], [1, 2, 3], 3)) + f" SELECT batch_id, num_negatives, {_METRICS} FROM metrics"
)
ORACLES["anchor_losses"] = ctes(slot_vectors(1, 32), losses([0.07], [1], 1)) + """
SELECT batch_id, sample_key, round(pos_sim, 6) AS pos_sim, round(neg_max, 6) AS neg_max, round(neg_lse, 6) AS neg_lse, round(loss, 6) AS loss
FROM anchor_loss"""
ORACLES["evaluate_packed"] = ctes(
    token_table(ROW_SAMPLES),
    f"""
scaled AS (SELECT pack_id || '-' || segment_id AS id, pack_id, sample_id, slot, {unit("vec")} AS vec FROM pooled),
each AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM scaled)""",
    layer("each", "out1", 64, 32, False),
    f"""
projected AS (SELECT id, list(x ORDER BY dim) AS vec FROM out1 GROUP BY id),
slot_vectors AS (
  SELECT s.pack_id // 4 AS batch_id, s.pack_id || '-' || s.sample_id AS sample_key, s.slot, {unit("p.vec")} AS vec
  FROM scaled s JOIN projected p USING (id)
)""",
    losses([0.07], [1], 1),
) + f" SELECT batch_id, {_METRICS} FROM metrics"

# --- streams ------------------------------------------------------------------------------------


def stream_packs(length: int, cap: int) -> str:
    """Greedy packing lane by lane; the pack open at the end of a lane comes after all others."""
    fits = f"w.held > 0 AND w.used + s.len <= {length} AND w.held + 1 <= {cap}"
    text = "list_concat(list_concat({}, {}), {})".format(*(POINTS.format(c) for c in ("text", "lang", "source")))
    lanes = f"(SELECT greatest({MIN_LANES}, ceil(count(*) / {LANE_ROWS}))::BIGINT FROM documents)"
    return f"""
items AS (
  SELECT doc_id, source, lane, ids, len(ids) AS len, len(ids) > {length} AS big, row_number() OVER (PARTITION BY lane ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, source, {text} AS ids,
    'documents/' || (('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % {lanes}) AS lane FROM documents)
),
sizes AS MATERIALIZED (SELECT lane, rn, len, big FROM items),
walk AS (
  SELECT DISTINCT lane, 0::BIGINT AS rn, 0::BIGINT AS used, 0::BIGINT AS held, -1::BIGINT AS p FROM sizes
  UNION ALL
  SELECT s.lane, s.rn,
    CASE WHEN s.big THEN w.used WHEN {fits} THEN w.used + s.len ELSE s.len END,
    CASE WHEN s.big THEN w.held WHEN {fits} THEN w.held + 1 ELSE 1 END,
    CASE WHEN s.big OR ({fits}) THEN w.p ELSE w.p + 1 END
  FROM walk w JOIN sizes s ON s.lane = w.lane AND s.rn = w.rn + 1
),
placed AS (
  SELECT lane, rn, big, p, count(*) FILTER (WHERE big) OVER (PARTITION BY lane ORDER BY rn ROWS UNBOUNDED PRECEDING)
    - CASE WHEN big THEN 1 ELSE 0 END AS over_before
  FROM sizes JOIN walk USING (lane, rn)
),
first_rows AS (SELECT lane, p, min(rn) AS rn FROM placed WHERE NOT big GROUP BY lane, p),
closing AS (
  SELECT f.lane, f.p, c.over_before
  FROM (SELECT lane, p, lead(rn) OVER (PARTITION BY lane ORDER BY p) AS rn FROM first_rows) f
  JOIN placed c ON c.lane = f.lane AND c.rn = f.rn
),
overs AS (SELECT lane, count(*) FILTER (WHERE big) AS n FROM sizes GROUP BY lane),
given AS (
  SELECT i.lane, i.rn, i.doc_id, i.source, i.ids,
    CASE WHEN x.big THEN x.over_before + greatest(x.p, 0) ELSE x.p + coalesce(c.over_before, o.n) END::BIGINT AS pack_no
  FROM items i JOIN placed x USING (lane, rn) JOIN overs o USING (lane) LEFT JOIN closing c ON c.lane = x.lane AND c.p = x.p
)"""


ORACLES["stream_pack"] = ctes(stream_packs(DOCS.seq_length, DOCS.max_samples)) + f"""
SELECT lane, pack_no, count(*)::INTEGER AS num_segments, {text_of("list(doc_id ORDER BY rn)")} AS sample_keys,
  {text_of(f"list_resize(flatten(list(ids ORDER BY rn))[1:{DOCS.seq_length}], {DOCS.seq_length}, 0)")} AS input_ids,
  md5(string_agg(source, ',' ORDER BY rn)) AS source_ids
FROM given GROUP BY lane, pack_no"""
# Where the batch ends and the stream begins leaves no trace.
ORACLES["stream_after_batch"] = ORACLES["stream_pack"]
ORACLES["stream_ingest"] = ctes(DOC_TRIPLETS, USABLE) + """
SELECT doc_id, length(anchor)::INTEGER AS anchor_chars, length(negative)::INTEGER AS negative_chars FROM usable"""

# --- other ways to the same rows ----------------------------------------------------------------

ORACLES["missing_ids_bitmaps"] = ORACLES["missing_ids"]
ORACLES["first_token_overlap_bitmaps"] = f"SELECT DISTINCT first_token FROM ({ORACLES['first_token_overlap']})"
ORACLES["bucketed_sample_info"] = ORACLES["batch_sample_info"]
ORACLES["bucketed_infonce"] = ORACLES["infonce_metrics"]
ORACLES["stream_once"] = ORACLES["stream_ingest"]
