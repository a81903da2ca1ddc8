"""Decisions on lines: how a listed word is meant, and evidence in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict(certain: Column, ambiguous: Column, has_line: Column, shows: Column, rude: Column, judged: Column, answer: Column, reason_ok: Column, trusted: Column, profane_above: float = 0.5, clean_below: float = 0.3) -> Column:
    """(use, reason): the first rule that applies. Only `harmless` spares a word; every doubt is `unsure`."""
    say = lambda use, reason: F.struct(F.lit(use).alias("use"), F.lit(reason).alias("reason"))
    return (
        F.when(certain, say("profane", "sexual line"))
        .when(~ambiguous, say("profane", "listed"))
        .when(~has_line, say("unsure", "no line"))
        .when(~shows, say("unsure", "not in line"))
        .when(rude >= profane_above, say("profane", "classifier"))
        .when(~judged, say("unsure", "not judged"))
        .when(~trusted, say("unsure", "not trusted"))
        .when((answer == "harmless") & ~reason_ok, say("unsure", "no reason"))
        .when((answer == "harmless") & (rude < clean_below), say("harmless", "judge"))
        .when(answer == "harmless", say("unsure", "classifier doubts"))
        .when(answer == "profane", say("profane", "judge"))
        .otherwise(say("unsure", "judge unsure"))
    )


def evidence(*signs: tuple[str, Column]) -> Column:
    """Names of the signs that hold, in the order given."""
    return F.filter(F.array(*(F.when(sign, F.lit(name)) for name, sign in signs)), lambda x: x.isNotNull())


def neighbours(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """df with the nearest earlier and later text that is not empty: previous, following."""
    spoken = F.when(F.col(text) != "", F.col(text))
    rows = Window.partitionBy(*keys).orderBy(order)
    before, after = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(1, Window.unboundedFollowing)
    return df.withColumns({"previous": F.last(spoken, True).over(before), "following": F.first(spoken, True).over(after)})


def share_of(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, share): how much of left's multiset of items is in right's."""
    a = left.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_b"))
    both = a.join(b, [*keys, item], "left").withColumn("_both", F.least("_a", F.coalesce("_b", F.lit(0))))
    return both.groupBy(*keys).agg((F.sum("_both") / F.sum("_a")).alias("share"))


def confusion(df: DataFrame, keys: list[str], truth: Column, said: Column) -> DataFrame:
    """(keys, n, precision, recall, false_flags): of rows said to be true against the truth."""
    both = F.count_if(truth & said)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(both, F.count_if(said)).alias("precision"), F.try_divide(both, F.count_if(truth)).alias("recall"), F.count_if(said & ~truth).alias("false_flags"))


#: fixed values: how a use can be meant, what a speaker can feel, and which meanings are harmless
REASONS = ("curse", "insult", "exclamation", "sexual", "literal", "religious", "place", "name", "other")
EMOTIONS = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")
HARMLESS = ("literal", "religious", "place", "name", "other")


def hide(text: Column, words: Column, mark: str = "[...]") -> Column:
    """A text with the words of an array hidden: whole words in any case, the longest first; words of a phrase may be parted by marks."""
    quoted = F.transform(words, lambda w: F.array_join(F.transform(F.filter(F.split(w, r"(?U)\s+"), lambda p: p != ""), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))), r"\W+"))
    ordered = F.array_sort(F.array_distinct(F.filter(quoted, lambda w: w != "")), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?iuU)(?<![\w'])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\w'])"))
    return F.when(F.size(ordered) > 0, F.regexp_replace(text, pattern, F.lit(mark.replace("$", r"\$")))).otherwise(text)


def shown_lines(lines: DataFrame, heard: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, text) with shown: the text with its ambiguous words (heard: keys, word) hidden."""
    words = heard.groupBy(*keys).agg(F.collect_set(F.regexp_replace("word", "^[ ,.!?;:\"']+|[ ,.!?;:\"']+$", "")).alias("_w"))
    shown = F.when(F.col("_w").isNotNull(), hide(F.col("text"), F.col("_w"))).otherwise(F.col("text"))
    return lines.join(words, keys, "left").withColumn("shown", shown).drop("_w")


def scored_lines(lines: DataFrame, heard: DataFrame, scores: DataFrame, keys: list[str], labels: tuple[str, ...]) -> DataFrame:
    """lines (keys, text) with a classifier's scores, those of the text with its ambiguous words hidden; 0 for empty lines.

    heard: keys, word: the ambiguous words of a line; scores: text, labels: what the classifier says of a text.
    """
    rows = shown_lines(lines, heard, keys).withColumnRenamed("shown", "_t")
    known = scores.select(F.col("text").alias("_t"), *labels)
    spoken = F.coalesce(F.col("text") != "", F.lit(False))
    return rows.join(known, "_t", "left").withColumns({x: F.when(spoken, F.coalesce(x, F.lit(0.0))).otherwise(0.0) for x in labels}).drop("_t")


def sexual_line(score: Column, phrases: Column, ambiguous: list[str], sounds: Column, judged: Column, least: float) -> Column:
    """(evidence, certain): why a line is sexual; a phrase of the ambiguous ones, or a sound, is no certain sign."""
    weak = lambda p: F.lower(p).isin(*ambiguous) if ambiguous else F.lit(False)
    by_score = F.when(score >= least, F.array(F.format_string("classifier %.2f", score))).otherwise(F.array().cast("array<string>"))
    by_phrase = F.transform(phrases, lambda p: F.concat(F.lit("phrase "), quoted(p), F.when(weak(p), " (ambiguous)").otherwise("")))
    by_sound = F.transform(sounds, lambda s: F.concat(F.lit("sound ["), s, F.lit("]")))
    sure = (score >= least) | F.exists(phrases, lambda p: ~weak(p))
    asked = F.coalesce(judged, F.lit(False)) & ~sure
    by_judge = F.when(asked, F.array(F.lit("judge"))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.concat(by_score, by_phrase, by_sound, by_judge).alias("evidence"), (sure | asked).alias("certain"))


def sexual_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, certain, possible) of lines with evidence."""
    return found.groupBy(*keys).agg(F.count_if("certain").alias("certain"), F.count_if(~F.col("certain")).alias("possible"))


def verdict_counts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how often each verdict was given."""
    return verdicts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def answered(before: DataFrame, after: DataFrame, key: str = "model") -> DataFrame:
    """(key, n): answers by model since an earlier count; models without new ones are left out."""
    old, new = (x.groupBy(key).agg(F.sum("n").alias(name)) for x, name in ((before, "_old"), (after, "n")))
    rows = new.join(old, key, "left").withColumn("n", F.col("n") - F.coalesce("_old", F.lit(0)))
    return rows.where("n > 0").select(key, "n")


def to_mute(detections: DataFrame, sexual: DataFrame, keep_harmless: bool, mute_sexual: bool) -> DataFrame:
    """What is muted: detections (media, start, end, term, category, use) less harmless uses that are kept, plus certain sexual lines.

    sexual: media, start, end, text, certain; start and end are of what was heard of a line, else the line's own.
    """
    kept = detections.where("use <> 'harmless'") if keep_harmless else detections
    kept = kept.select("media", "start", "end", "term", "category")
    lines = sexual.where("certain and text <> ''").select("media", "start", "end", F.lit("sexual line").alias("term"), F.lit("context").alias("category"))
    return kept.unionByName(lines) if mute_sexual else kept


def review_note(use: Column, reason: Column) -> Column:
    """What a review says of a use; nothing of a plain profane one."""
    return F.when(use == "harmless", F.concat(F.lit("probably harmless: "), reason)).when(use == "unsure", F.concat(F.lit("unsure: "), reason)).when(reason == "sexual line", "sexual line")


def quoted(text: Column) -> Column:
    """A text as JSON writes it."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def dialogue(before: Column, line: Column, after: Column) -> Column:
    """A line between its neighbours, marked; empty or null neighbours are left out."""
    beside = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("   "), quoted(c)))
    return F.concat_ws("\n", beside(before), F.concat(F.lit(">> "), quoted(line)), beside(after))


def question(kind: str, shown: Column, word: Column, choices: Column | None = None) -> Column:
    """What a judge is asked about the marked line of a dialogue: the sense of a word, whether it is sexual, or a substitute."""
    names = lambda xs: ", ".join(f'"{x}"' for x in xs)
    head = F.concat(F.lit("Dialogue:\n"), shown, F.lit("\n\n"))
    if kind == "sense":
        ask = f' meant in the line marked >>? Answer with {{"use": ..., "reason": ..., "emotion": ...}}: use is "profane" or "harmless", reason is one of {names(REASONS)}, emotion is one of {names(EMOTIONS)}.'
        return F.concat(head, F.lit("How is the word "), quoted(word), F.lit(ask))
    if kind == "sexual":
        return F.concat(head, F.lit('Is the line marked >> sexual, or does it hint at that? Answer with {"sexual": true} or {"sexual": false}.'))
    if kind == "substitute" and choices is not None:
        offered = F.array_join(F.transform(choices, quoted), ", ")
        return F.concat(head, F.lit("The word "), quoted(word), F.lit(" of the line marked >> makes room for a milder one. Which keeps the line natural: "), offered, F.lit('? Answer with {"substitute": ...}, null if none does.'))
    raise ValueError(f"no question of kind {kind!r}")


def truth_overlap(truth: DataFrame, spans: DataFrame, found: DataFrame, keys: list[str], id: str, size: float) -> DataFrame:
    """truth (keys, id, start, end) with covered (share of it that spans mute), start_error and end_error of the nearest detection.

    spans: keys, start, end, not overlapping; found: keys, start, end. Errors are null where no detection overlaps (open).
    """
    from loomspan.operators.spans import overlap_join

    right = lambda df: df.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    own = truth.select(*keys, id, "start", "end")
    shared = overlap_join(own, right(spans), keys, size).groupBy(id).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("_s"))
    near = F.min_by(F.struct("r_start", "r_end"), F.struct(F.abs(F.col("r_start") - F.col("start")), "r_start", "r_end"))
    best = overlap_join(own, right(found), keys, size).groupBy(id).agg(near.alias("_b"))
    rows = truth.join(shared, id, "left").join(best, id, "left")
    covered = F.coalesce("_s", F.lit(0)) / F.greatest(F.col("end") - F.col("start"), F.lit(1e-9))
    return rows.withColumns({"covered": covered, "start_error": F.col("_b.r_start") - F.col("start"), "end_error": F.col("_b.r_end") - F.col("end")}).drop("_s", "_b")


def median_low(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, middle, low_middle): the median, and the lower of the two middle values."""
    return df.groupBy(*keys).agg(F.median(value).alias("middle"), F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("low_middle"))
