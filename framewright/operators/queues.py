"""Temporal queues: each frame with a sampled piece of its history.

A queue is an array column, ``members``, of structs in time order:

    slot      position in the queue, from 0
    pos       position in the history window, 0 .. length (length = current)
    frame_no  the frame taken, after clamping at the first frame
    frame     the columns of that frame, null if there is no such frame
    before    the columns of the frame in the slot before, null in slot 0

Building the array costs one shuffle. All steps after it look at one row at
a time, so none of them shuffles. Each of them names ``members`` once, so
that Catalyst can merge or move them without repeating the work below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framewright.functions.binding import let
from framewright.functions.draws import clamp_index, seeded_draw
from framewright.session import materialize

BLOCK_ROWS = 512
DRAWS_PER_COPY = 1000
WORD_BITS = 62  # queue numbers in one word of a bitmap
WORDS_PER_BLOCK = 4096


def history_window(
    frames: DataFrame,
    length: int,
    columns: Sequence[str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Frames i-length .. i for every frame i, by global position.

    The frames are cut into blocks of equal size, so no scene can make a
    large task, and every block also receives the ``length`` rows before it.
    The window then runs inside a block. It is a range window on the frame
    number: a gap in the numbers gives a null member, not a shifted one.
    """
    if length < 0:
        raise ValueError("length must not be negative")
    frame_no = F.col("frame_no")
    spread = frames.withColumn(
        "_block",
        F.explode(
            F.sequence(
                F.floor(frame_no / block_rows), F.floor((frame_no + length) / block_rows)
            )
        ),
    )
    window = W.partitionBy("_block").orderBy("frame_no").rangeBetween(-length, 0)
    inner = F.struct("frame_no", *[c for c in columns if c != "frame_no"])
    near = spread.withColumn("_near", F.collect_list(inner).over(window)).where(
        F.col("_block") == F.floor(frame_no / block_rows)
    )

    def member(pos: Column) -> Column:
        wanted = clamp_index(frame_no - length + pos)
        near = F.col("_near")
        # without gaps the frame stands at its distance from the oldest one
        likely = F.get(near, (wanted - F.get(near, F.lit(0))["frame_no"]).cast("int"))
        found = F.when(likely["frame_no"] == wanted, likely).otherwise(
            F.get(F.filter(near, lambda f: f["frame_no"] == wanted), F.lit(0))
        )
        return F.struct(pos.alias("pos"), wanted.alias("frame_no"), found.alias("frame"))

    return near.select(
        frame_no.alias("queue_no"),
        *[c for c in frames.columns if c != "frame_no"],
        # one expression per position, the length being known: compiled, unlike a lambda
        F.array(*[member(F.lit(pos)) for pos in range(length + 1)]).alias("members"),
    )


def drop_one_history(queues: DataFrame, length: int, seed: int, draw: Column | None = None) -> DataFrame:
    """Drop one history member, drawn uniformly per queue; order is kept.

    ``draw`` overrides the seeded draw with a position in ``[0, length)``.
    """
    if length == 0:
        return queues
    dropped = (seeded_draw(F.col("queue_no"), seed, length) if draw is None else draw).cast("int")

    members, drop = F.col("members"), F.col("_drop")
    kept = F.array(
        *[F.when(drop > k, members[k]).otherwise(members[k + 1]) for k in range(length)]
    )
    return queues.withColumn("_drop", dropped).withColumn("members", kept).drop("_drop")


def queue_order(queues: DataFrame, slots: int | None = None) -> DataFrame:
    """Number the slots, history ascending and current last, and link each
    member to the one before. The members arrive in the order of ``pos``.

    Give the number of ``slots`` if all queues have that many: the expression
    is compiled then.
    """
    frame = queues.schema["members"].dataType.elementType["frame"].dataType
    nothing = F.lit(None).cast(frame)

    def numbered(m: Column, k: Column, before: Column) -> Column:
        return F.struct(
            k.alias("slot"), *_fields(m, "pos", "frame_no", "frame"), before.alias("before")
        )

    def linked(members: Column) -> Column:
        return F.transform(
            members, lambda m, k: numbered(m, k, F.get(members, k - 1)["frame"])
        )

    if slots is None:
        return queues.withColumn("members", let(F.col("members"), linked))
    members = F.col("members")
    return queues.withColumn(
        "members",
        F.array(
            *[
                numbered(members[k], F.lit(k), members[k - 1]["frame"] if k else nothing)
                for k in range(slots)
            ]
        ),
    )


def build_queues(
    frames: DataFrame,
    length: int,
    columns: Sequence[str],
    seed: int,
    draw: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window, drop one, number the slots: ``max(length, 1)`` slots per frame."""
    queues = history_window(frames, length, columns, block_rows)
    return queue_order(drop_one_history(queues, length, seed, draw), max(length, 1))


def has_ground_truth(labels: str | Column, ignore: int = -1) -> Column:
    """True if some label is not the ignore value; null or no labels: false."""
    return F.coalesce(F.exists(labels, lambda x: x != ignore), F.lit(False))


def label_flag(frames: DataFrame, labels: str | Column, name: str = "has_gt") -> DataFrame:
    """Add one bit a frame, ``name``: whether it has a usable label.

    A frame is a member of several queues; the bit goes into their windows
    in place of the labels, which are looked at once.
    """
    return frames.withColumn(name, has_ground_truth(labels))


def queue_accepted(labels: str = "gt_labels", ignore: int = -1, flag: str | None = None) -> Column:
    """True if every member exists and has a usable label, or the ``flag`` that says so."""

    def usable(frame: Column) -> Column:
        return F.coalesce(frame[flag], F.lit(False)) if flag else has_ground_truth(frame[labels], ignore)

    return F.forall("members", lambda m: m["frame"].isNotNull() & usable(m["frame"]))


def filter_empty_queues(
    queues: DataFrame, labels: str = "gt_labels", enabled: bool = True, flag: str | None = None
) -> DataFrame:
    """Reject a whole queue if a member is missing or, if enabled, unlabelled."""
    if not enabled:
        return queues.where(F.forall("members", lambda m: m["frame"].isNotNull()))
    return queues.where(queue_accepted(labels, flag=flag))


def rank_words(numbers: DataFrame, name: str = "queue_no") -> DataFrame:
    """A bitmap of distinct numbers from 0 that can be searched by rank.

    One row a word: ``_word``, its ``_bits``, how many are set, and ``_start``,
    how many numbers the words before it hold. Words are counted inside blocks
    of ``WORDS_PER_BLOCK``, and only the blocks' sums meet a global window.
    """
    number = F.col(name)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (number % WORD_BITS).cast("int"))
    words = numbers.groupBy(F.floor(number / WORD_BITS).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    words = words.select("*", F.bit_count("_bits").cast("long").alias("_n"), F.floor(F.col("_word") / WORDS_PER_BLOCK).alias("_block"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_n").over(before(W.partitionBy("_block").orderBy("_word"))), F.lit(0))
    blocks = words.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    # one row for WORD_BITS * WORDS_PER_BLOCK numbers
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(before(W.orderBy("_block"))), F.lit(0)).alias("_before"))
    return words.withColumn("_inside", inside).join(F.broadcast(blocks), "_block").select(
        "_word", "_bits", "_n", (F.col("_before") + F.col("_inside")).alias("_start")
    )


def select_ranked(words: DataFrame, drawn: DataFrame, copies: int = 1, name: str = "queue_no") -> DataFrame:
    """``drawn`` with the number at place ``_rank``, from 0, of the bitmap.

    A word holds at most ``WORD_BITS`` ranks, so it meets the ranks of two
    buckets of that many, and a bucket meets few words: one equi-join. Words
    are copied ``copies`` times, and ``drawn`` says by ``_copy`` which it takes.
    """
    first, last = F.col("_start"), F.col("_start") + F.col("_n") - 1
    buckets = F.sequence(F.floor(first / WORD_BITS), F.floor(last / WORD_BITS))
    spread = words.withColumn("_bucket", F.explode(buckets)).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    met = drawn.withColumn("_bucket", F.floor(F.col("_rank") / WORD_BITS)).join(spread, ["_bucket", "_copy"])
    met = met.where(F.col("_rank").between(first, last))
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda k: F.call_function("getbit", F.col("_bits"), k) == 1)
    place = F.get(places, (F.col("_rank") - first).cast("int"))
    return met.withColumn(name, F.col("_word") * WORD_BITS + place).drop("_bucket", "_word", "_bits", "_n", "_start", "_rank")


def replace_rejected(queues: DataFrame, seed: int, labels: str = "gt_labels", flag: str | None = None) -> DataFrame:
    """Give every rejected queue number the content of a drawn accepted one.

    The queues are built and stored once. The accepted numbers become a bitmap
    with counts, in which a drawn rank finds its donor; the donors' contents
    are then joined. Each donor is copied often enough that about
    ``DRAWS_PER_COPY`` rejected queues meet one copy, so few donors for many
    queues make no hot key, and the copies stay below the number of all queues.
    Without any accepted queue it is an error, as the number of queues could
    not stay the same.
    """
    content = [c for c in queues.columns if c != "queue_no"]
    stored = materialize(queues.withColumn("_good", queue_accepted(labels, flag=flag)), "queues")
    total, rejected = stored.agg(F.count_if(F.col("_good")), F.count_if(~F.col("_good"))).first()
    source = F.col("queue_no").alias("source_queue_no")
    as_is = stored.where("_good").select("queue_no", source, *content)
    if not rejected:
        return as_is
    if not total:
        raise ValueError("no queue is accepted, so none can replace the rejected ones")
    n_copies = -(-rejected // (total * DRAWS_PER_COPY))
    copy = F.pmod(F.xxhash64("queue_no"), F.lit(n_copies)).cast("int")
    drawn = stored.where(~F.col("_good")).select("queue_no", seeded_draw(F.col("queue_no"), seed, total).alias("_rank"), copy.alias("_copy"))
    donors = select_ranked(rank_words(stored.where("_good").select("queue_no")), drawn, n_copies, "source_queue_no")
    copies = F.explode(F.sequence(F.lit(0), F.lit(n_copies - 1))).alias("_copy")
    contents = stored.where("_good").select(source, *content, copies)
    replaced = donors.join(contents, ["source_queue_no", "_copy"])
    return as_is.unionByName(replaced.select("queue_no", "source_queue_no", *content))


def scene_start_flag(queues: DataFrame, scene: str = "scene_token") -> DataFrame:
    """Add ``prev_bev_exists`` to each member: same scene as the slot before."""
    return _with_field(
        queues,
        "prev_bev_exists",
        lambda m: F.coalesce(m["frame"][scene] == m["before"][scene], F.lit(False)),
    )


def relative_pose(queues: DataFrame, vector: str = "can_bus") -> DataFrame:
    """Make position and heading of each member relative to the slot before.

    Elements 0-2 and the last of the vector become differences to the
    previous slot's absolute values, or zero where a scene starts. The angle
    is not wrapped, and the other elements stay absolute. Needs
    ``prev_bev_exists``; adds the vector as ``relative``.
    """

    def changed(m: Column) -> Column:
        now, before, n = m["frame"][vector], m["before"][vector], F.size(m["frame"][vector])

        def step(i: Column | int) -> Column:
            return F.when(m["prev_bev_exists"], F.get(now, i) - F.get(before, i)).otherwise(0.0)

        position = F.array(*[step(F.lit(i)) for i in range(3)])
        return F.concat(position, F.slice(now, F.lit(4), n - 4), F.array(step(n - 1)))

    return _with_field(queues, "relative", changed)


def stack_queue(queues: DataFrame, image: str = "img", shape: str = "img_shape") -> DataFrame:
    """Add ``img``, the image references of all slots; shapes must be equal."""
    shapes = F.array_distinct(F.transform("members", lambda m: m["frame"][shape]))
    return queues.withColumn(
        "img",
        F.when(F.size(shapes) == 1, F.transform("members", lambda m: m["frame"][image])).otherwise(
            F.raise_error(F.lit("images of one queue differ in shape"))
        ),
    )


def queue_metas(queues: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add ``img_metas``, a map from slot to the named fields of the member."""
    names = [f.name for f in queues.schema["members"].dataType.elementType]

    def meta(m: Column) -> Column:
        return F.struct(*[(m[f] if f in names else m["frame"][f]).alias(f) for f in fields])

    return queues.withColumn(
        "img_metas",
        F.map_from_entries(F.transform("members", lambda m: F.struct(m["slot"], meta(m)))),
    )


def merge_queue(
    queues: DataFrame,
    fields: Sequence[str],
    image: str = "img",
    shape: str = "img_shape",
) -> DataFrame:
    """The current frame's own columns with all images and metas of its queue."""
    own = [c for c in queues.columns if c not in ("members", image)]
    merged = queue_metas(stack_queue(queues, image, shape), fields)
    return merged.select(*own, "img", "img_metas")


def queue_rows(queues: DataFrame, frame_fields: Sequence[str] = ()) -> DataFrame:
    """One row per queue and slot."""
    element = queues.schema["members"].dataType.elementType
    plain = [f.name for f in element if f.name not in ("frame", "before")]

    def slot(m: Column) -> Column:
        return F.struct(*_fields(m, *plain), *_fields(m["frame"], *frame_fields))

    return queues.select("queue_no", F.inline(F.transform("members", slot)))


def _fields(struct: Column, *names: str) -> list[Column]:
    return [struct[n].alias(n) for n in names]


def _with_field(queues: DataFrame, name: str, value) -> DataFrame:
    """Add a field to each member, computed from that member."""
    names = [f.name for f in queues.schema["members"].dataType.elementType]
    return queues.withColumn(
        "members",
        F.transform("members", lambda m: F.struct(*_fields(m, *names), value(m).alias(name))),
    )
