"""Section-aware chunking as DataFrame plans.

Documents become sections (one fold over their lines), sections become elements (sentences, table row
groups), and one fold packs these into token-bounded pieces.  Offsets are code points in the original
text.  All of it happens in a document's own row: nothing is shuffled, and nothing leaves the JVM.

The fold's state is small: where the open piece begins, its tokens, and the pieces closed so far as index
ranges.  Texts and spans are made from the ranges afterwards, once, so that the work grows with the text.

Tokens are what the ``Tokenizer`` counts.  Where its counts don't add up over sentences, the open piece's
text is carried along and each candidate is counted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.ids import Limits, chunk_id, fingerprint
from vellum.functions.tokenizers import WORDS, Tokenizer

SPAN = "struct<start:int,end:int>"
GROUP = f"struct<spans:array<{SPAN}>,header:string,rendered:string,tok:int>"
#: Where a piece lies among a section's elements: its first, the end of its first unit, its last; ``at`` is where the first begins.
RANGE = "struct<kind:string,first:int,head:int,last:int,at:int,tok:int,overlap:int,cut:boolean>"
OPEN = f"struct<at:int,i:int,first:int,head:int,last:int,start:int,tok:int,overlap:int,text:string,out:array<{RANGE}>>"
PIECE = f"struct<spans:array<{SPAN}>,tok:int,header:string,rendered:string,overlap:int,part:int,cut:boolean>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def sections(docs: DataFrame) -> DataFrame:
    """document_version_id, document_title, section_ordinal, section_id, heading, body, body_start, body_end, access_policy_id.

    ``docs``: document_version_id, document_title, access_policy_id, text and, if wanted,
    access_by_heading (map from heading to policy).  Text before the first heading is a section named
    after the document; it keeps the document's policy.  Blank documents give none.
    """
    key, named = "document_version_id", "access_by_heading" in docs.columns

    def read(lines: Column) -> Column:
        """The headings with where their lines begin and the lines' numbers."""
        heads = F.filter(F.transform(lines, lambda x, i: F.struct(T.heading(x).alias("heading"), i.alias("line"))), lambda h: h["heading"].isNotNull())

        def placed(h: Column) -> Column:
            at = T.sums_before(F.transform(lines, lambda x: F.length(x) + 1))
            return T.let(at, lambda before: F.transform(h, lambda x: F.struct(x["heading"].alias("heading"), F.get(before, x["line"]).alias("at"), x["line"].alias("line"))))

        return T.let(heads, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(_none("struct<heading:string,at:int,line:int>")))

    def parts(lines: Column, heads: Column) -> Column:
        total = F.length("text")

        def body(first: Column, count: Column, last: Column) -> Column:
            return F.concat(F.array_join(F.slice(lines, first + 1, count), "\n"), F.when(last | (count == 0), "").otherwise("\n"))

        def one(h: Column, i: Column) -> Column:
            after = F.get(heads, i + 1)
            stop, start = F.coalesce(after["line"], F.size(lines)), h["line"] + 1
            begin = F.least(h["at"] + F.length(F.get(lines, h["line"])) + 1, total)
            text = F.when(start < F.size(lines), body(start, stop - start, after.isNull())).otherwise("")
            return F.struct(h["heading"].alias("heading"), begin.alias("start"), (begin + F.length(text)).alias("end"), text.alias("body"), F.lit(True).alias("named"))

        upto = F.get(heads, F.lit(0))
        before = F.when(upto.isNull(), F.col("text")).otherwise(body(F.lit(0), upto["line"], F.lit(False)))
        head = T.let(before, lambda b: F.when(b.rlike(r"(?U)\S"), F.array(F.struct(
            F.col("document_title").alias("heading"), F.lit(0).alias("start"), F.length(b).alias("end"), b.alias("body"), F.lit(False).alias("named")))))
        kind = "struct<heading:string,start:int,end:int,body:string,named:boolean>"
        return F.concat(F.coalesce(head, _none(kind)), F.transform(heads, one))

    every = T.let(F.split("text", "\n", -1), lambda lines: T.let(read(lines), lambda heads: parts(lines, heads)))
    rows = docs.where("text is not null").select(key, "document_title", "access_policy_id", *(["access_by_heading"] if named else []), F.posexplode(every).alias("section_ordinal", "x"))
    override = F.try_element_at("access_by_heading", F.col("x.heading")) if named else F.lit(None).cast("string")
    return rows.select(
        key, "document_title", "section_ordinal", F.concat_ws(":", key, "x.heading").alias("section_id"), F.col("x.heading").alias("heading"), F.col("x.body").alias("body"),
        F.col("x.start").alias("body_start"), F.col("x.end").alias("body_end"),
        F.when(F.col("x.named"), F.coalesce(override, F.col("access_policy_id"))).otherwise(F.col("access_policy_id")).alias("access_policy_id"))


# ---------------------------------------------------------------- elements


def _element(raw: Column, kept: Column, tokenizer: Tokenizer, group: Column | None = None) -> Column:
    """``r`` is all of an element's text, ``t`` what counts of it; a table's group stands where its block begins."""
    return F.struct(
        raw.alias("r"), kept.alias("t"), F.length(raw).alias("n"), tokenizer.count(kept).cast("int").alias("tok"), T.is_exception(kept).alias("exc"),
        (F.lit(None).cast(GROUP) if group is None else group).alias("group"))


def _sentences(text: Column, tokenizer: Tokenizer) -> Column:
    raw = F.filter(F.regexp_extract_all(text, F.lit(T.SENTENCE), F.lit(0)), lambda x: x != "")
    return F.transform(raw, lambda r: T.let(T.trim_end(r), lambda t: _element(r, t, tokenizer)))


def _table_groups(block: Column, lines: Column, rule: Column, tokenizer: Tokenizer, most: int) -> Column:
    """Row groups that repeat the header, as many rows as fit; the lines up to the first rule (number ``rule``, from 1) are the header."""
    top = F.slice(lines, F.lit(1), rule)

    def shaped(line: Column) -> Column:
        return T.is_table_row(line) | T.is_table_rule(line)

    def groups(size: Column, shown: Column, header: Column, end: Column) -> Column:
        def group(rows: Column) -> Column:
            spans = F.concat(F.array(_span(F.lit(0), size)), F.transform(rows, lambda r: _span(r["s"], F.least(r["e"], end))))
            rendered = F.concat(shown, F.lit("\n"), F.array_join(F.transform(rows, lambda r: r["t"]), "\n"))
            return T.let(rendered, lambda t: F.struct(spans.alias("spans"), header.alias("header"), t.alias("rendered"), tokenizer.count(t).cast("int").alias("tok")))

        def read(rest: Column) -> Column:
            def one(before: Column) -> Column:
                placed = F.transform(rest, lambda line, i: F.struct(line.alias("line"), (size + F.get(before, i)).alias("s")))
                rows = F.filter(placed, lambda x: T.is_table_row(x["line"]) & ~T.is_table_rule(x["line"]))
                return F.transform(rows, lambda x: T.let(T.strip(x["line"]), lambda t: F.struct(
                    x["s"].alias("s"), (x["s"] + F.length(x["line"]) + 1).alias("e"), t.alias("t"), (tokenizer.count(t) if tokenizer.additive else F.lit(0)).cast("int").alias("tok"))))

            return T.let(T.sums_before(F.transform(rest, lambda x: F.length(x) + 1)), one)

        def ends(rows: Column, own: Column) -> Column:
            """The first row of each group, as a fold over the rows: what is carried is the open group's tokens, or its text where they don't add up."""

            def step(a: Column, r: Column) -> Column:
                def with_text(text: Column) -> Column:
                    def state(tok: Column, text: Column, out: Column) -> Column:
                        return F.struct((a["i"] + 1).alias("i"), tok.cast("int").alias("tok"), text.alias("text"), out.alias("out"))

                    def alone() -> Column:
                        t = F.concat(shown, F.lit("\n"), r["t"])
                        tok = own + r["tok"] if tokenizer.additive else tokenizer.count(t)
                        fits = T.let(tok, lambda n: F.when(n <= most, n).otherwise(F.raise_error(F.lit("a table row with its header exceeds the token limit")).cast("int")))
                        return state(fits, F.lit("") if tokenizer.additive else t, F.array_append(a["out"], a["i"]))

                    tok = a["tok"] + r["tok"] if tokenizer.additive else tokenizer.count(text)
                    return T.let(tok, lambda n: F.when((a["i"] > 0) & (n <= most), state(n, text, a["out"])).otherwise(alone()))

                return with_text(F.lit("")) if tokenizer.additive else T.let(F.concat(a["text"], F.lit("\n"), r["t"]), with_text)

            zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("tok"), F.lit("").alias("text"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(rows, zero, step, lambda a: a["out"])

        def cut(rows: Column) -> Column:
            first = T.let(tokenizer.count(shown).cast("int"), lambda own: ends(rows, own))
            return T.let(first, lambda f: F.transform(f, lambda at, i: group(F.slice(rows, at + 1, F.coalesce(F.get(f, i + 1), F.size(rows)) - at))))

        return T.let(F.slice(lines, rule + 1, F.size(lines)), lambda rest: T.let(read(rest), cut))

    text = F.array_join(top, "\n")
    return T.let(F.length(text) + 1, lambda size: T.let(T.strip(text), lambda shown: T.let(
        T.strip(F.array_join(F.filter(top, shaped), "\n")), lambda header: T.let(F.length(block), lambda end: groups(size, shown, header, end)))))


def _block(raw: Column, tokenizer: Tokenizer, most: int) -> Column:
    """A block's elements; lines of a table's block that are no rows follow as sentences, so that nothing is lost."""
    block = T.trim_end(raw)

    def table(lines: Column, rule: Column) -> Column:
        blank = F.array(_element(raw, F.lit(""), tokenizer))

        def with_lines(groups: Column) -> Column:
            stood = F.transform(groups, lambda g: _element(F.lit(""), g["rendered"], tokenizer, g))

            def after(line: Column, i: Column) -> Column:
                whole = F.concat(line, F.when(i + 1 < F.size(lines), "\n").otherwise(""))
                prose = (i >= rule) & ~T.is_table_row(line) & ~T.is_table_rule(line) & line.rlike(r"(?U)\S")
                return F.when(prose, _sentences(whole, tokenizer)).otherwise(F.array(_element(whole, F.lit(""), tokenizer)))

            rest = F.substring(raw, F.length(block) + 1, F.length(raw))  # white space behind the block
            return F.when(F.size(groups) == 0, _sentences(raw, tokenizer)).otherwise(
                F.concat(stood, F.flatten(F.transform(lines, after)), F.array(_element(rest, F.lit(""), tokenizer))))

        return F.when(block == "", blank).when(rule == 0, _sentences(raw, tokenizer)).otherwise(T.let(_table_groups(block, lines, rule, tokenizer, most), with_lines))

    return T.let(F.split(block, "\n"), lambda lines: T.let(
        F.array_position(F.transform(lines, T.is_table_rule), True).cast("int"), lambda rule: table(lines, rule)))


def elements(body: Column, tokenizer: Tokenizer, most: int) -> Column:
    blocks = F.regexp_extract_all(body, F.lit(r"(?sU)(?:[^\n]++|\n(?!\s*\n))*+(?:\n\s*\n|\z)"), F.lit(0))
    by_block = F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), lambda b: _block(b, tokenizer, most)))
    return F.when(T.has_table(body), by_block).otherwise(_sentences(body, tokenizer))


# ---------------------------------------------------------------- packing


def packed_ranges(units: Column, start: Column, limits: Limits, tokenizer: Tokenizer) -> Column:
    """Packs elements greedily: to the target, exceptions up to the maximum; longer ones and table groups stand alone."""

    def state(a: Column, u: Column, **new: Column) -> Column:
        names = ("first", "head", "last", "start", "tok", "overlap", "text", "out")
        moved = [(a["at"] + u["n"]).alias("at"), (a["i"] + 1).alias("i")]
        return F.struct(*moved, *[new.get(n, a[n]).alias(n) for n in names])

    def piece(kind: str, first, head, last, at, tok, overlap, cut) -> Column:
        return F.struct(*[x.alias(n) for n, x in (("kind", F.lit(kind)), ("first", first), ("head", head), ("last", last), ("at", at), ("tok", tok), ("overlap", overlap), ("cut", cut))])

    def closed(a: Column, cut: Column, *more: Column) -> Column:
        one = F.array(piece("text", a["first"], a["head"], a["last"], a["start"], a["tok"], a["overlap"], cut))
        out = F.when(a["first"] >= 0, F.concat(a["out"], one)).otherwise(a["out"])
        return F.concat(out, F.array(*more)) if more else out

    def alone(a: Column, u: Column, kind: str) -> Column:
        one = piece(kind, a["i"], a["i"], a["i"], a["at"], F.coalesce(u["group"]["tok"], u["tok"]), F.lit(0), F.lit(False))
        return state(a, u, first=F.lit(-1), text=F.lit(""), out=closed(a, F.lit(False), one))

    def begun(a: Column, u: Column, out: Column) -> Column:
        return state(a, u, first=a["i"], head=a["i"], last=a["i"], start=a["at"], tok=u["tok"], overlap=F.lit(0), text=F.lit("") if tokenizer.additive else u["t"], out=out)

    def overlapped(a: Column, u: Column) -> Column:
        """Whole sentences from the end of the piece just closed, while they fit the overlap; it must be one span."""
        kind = "struct<go:boolean,back:int,taken:int,kept_tok:int,seen:int,size:int,tok:int,text:string,kept:string>"

        def back(b: Column, x: Column) -> Column:
            def counted(text: Column, tok: Column) -> Column:
                def picked(take: Column, fits: Column) -> Column:
                    new = {"back": b["size"] + x["n"], "taken": b["seen"] + 1, "kept_tok": tok, "kept": text}
                    pick = {n: F.when(take, v).otherwise(b[n]) for n, v in new.items()}
                    return F.struct(
                        (fits | (x["t"] == "")).alias("go"), pick["back"].alias("back"), pick["taken"].alias("taken"), pick["kept_tok"].alias("kept_tok"),
                        (b["seen"] + 1).alias("seen"), (b["size"] + x["n"]).alias("size"), tok.cast("int").alias("tok"), text.alias("text"), pick["kept"].alias("kept"))

                return T.let(tok <= limits.overlap, lambda fits: T.let((x["t"] != "") & fits, lambda take: picked(take, fits)))

            if tokenizer.additive:  # what was skipped stands in the text as well
                own = F.when(x["t"] != "", x["tok"]).otherwise(tokenizer.count(x["r"]).cast("int"))
                return F.when(b["go"], T.let(b["tok"] + own, lambda tok: counted(F.lit(""), tok))).otherwise(b)
            return F.when(b["go"], T.let(F.concat(x["r"], b["text"]), lambda text: T.let(tokenizer.count(T.trim_end(text)).cast("int"), lambda tok: counted(text, tok)))).otherwise(b)

        def joined(v: Column) -> Column:
            def grown(text: Column, both: Column, behind: Column) -> Column:
                one = state(a, u, first=a["i"] - v["taken"], head=a["i"], last=a["i"], start=a["at"] - v["back"], tok=both, overlap=behind,
                            text=F.lit("") if tokenizer.additive else text, out=closed(a, F.lit(False)))
                return F.when((v["taken"] > 0) & (both <= limits.most), one).otherwise(begun(a, u, closed(a, F.lit(False))))

            if tokenizer.additive:
                return T.let(v["kept_tok"] + u["tok"], lambda both: grown(F.lit(""), both, v["kept_tok"]))
            text = F.concat(v["kept"], u["t"])
            return T.let(text, lambda t: T.let(tokenizer.count(t).cast("int"), lambda both: grown(t, both, tokenizer.count(v["kept"]).cast("int"))))

        zero = F.struct(F.lit(True), *[F.lit(0)] * 6, F.lit(""), F.lit("")).cast(kind)
        tail = F.aggregate(F.reverse(F.slice(units, a["first"] + 1, a["i"] - a["first"])), zero, back)
        return F.when((a["head"] == a["last"]) & F.lit(limits.overlap > 0), T.let(tail, joined)).otherwise(begun(a, u, closed(a, F.lit(False))))

    def step(a: Column, u: Column) -> Column:
        def packed(text: Column, tok: Column) -> Column:
            appended = state(a, u, last=a["i"], tok=tok, text=text)
            return (
                F.when(u["exc"] & (tok <= limits.most), appended)
                .when(u["exc"], begun(a, u, closed(a, F.lit(True))))
                .when(tok <= limits.target, appended)
                .otherwise(overlapped(a, u))
            )

        if tokenizer.additive:
            grown = T.let(a["tok"] + u["tok"], lambda tok: packed(F.lit(""), tok))
        else:
            grown = T.let(F.concat(a["text"], F.lit("\n"), u["t"]), lambda text: T.let(tokenizer.count(text).cast("int"), lambda tok: packed(text, tok)))
        return (
            F.when(u["group"].isNotNull(), alone(a, u, "table"))
            .when(u["t"] == "", state(a, u))
            .when(u["tok"] > limits.most, alone(a, u, "slice"))
            .when(a["first"] < 0, begun(a, u, a["out"]))
            .otherwise(grown)
        )

    minus, zero = F.lit(-1), F.lit(0)
    empty = F.struct(start, zero, minus, minus, minus, zero, zero, zero, F.lit(""), _none(RANGE)).cast(OPEN)
    return F.aggregate(units, empty, step, lambda a: closed(a, F.lit(False)))


def _pieces(units: Column, ranges: Column, limits: Limits, tokenizer: Tokenizer) -> Column:
    """Texts and spans of the ranges."""

    def finished(spans: Column, text: Column, tok: Column, part: Column, p: Column, header: Column | None = None) -> Column:
        header = F.lit(None).cast("string") if header is None else header
        return F.struct(spans.alias("spans"), tok.cast("int").alias("tok"), header.alias("header"), text.alias("rendered"), p["overlap"].alias("overlap"), part.alias("part"), p["cut"].alias("cut"))

    def text_piece(p: Column) -> Column:
        def add(a: Column, u: Column) -> Column:
            kept = u["t"] != ""
            return F.struct(
                (a["at"] + u["n"]).alias("at"), F.when(kept, F.concat(a["spans"], F.array(_span(a["at"], a["at"] + F.length(u["t"]))))).otherwise(a["spans"]).alias("spans"),
                F.when(kept, F.concat(a["texts"], F.array(u["t"]))).otherwise(a["texts"]).alias("texts"))

        def with_head(raw: Column) -> Column:
            head = T.trim_end(raw)
            start = F.struct((p["at"] + F.length(raw)).alias("at"), F.array(_span(p["at"], p["at"] + F.length(head))).alias("spans"), F.array(head).alias("texts"))
            rest = F.slice(units, p["head"] + 2, p["last"] - p["head"])
            return F.aggregate(rest, start, add, lambda a: finished(a["spans"], F.array_join(a["texts"], "\n"), p["tok"], F.lit(0), p))

        return F.array(T.let(F.array_join(F.transform(F.slice(units, p["first"] + 1, p["head"] - p["first"] + 1), lambda u: u["r"]), ""), with_head))

    def slice_piece(p: Column, u: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            text = F.substring(u["t"], s["start"] + 1, s["end"] - s["start"])
            return finished(F.array(_span(p["at"] + s["start"], p["at"] + s["end"])), text, tokenizer.count(text), i, p)

        return F.transform(tokenizer.slices(u["t"], limits.most), part)

    def table_piece(p: Column, g: Column) -> Column:
        spans = F.transform(g["spans"], lambda s: _span(p["at"] + s["start"], p["at"] + s["end"]))
        return F.array(finished(spans, g["rendered"], g["tok"], F.lit(0), p, g["header"]))

    def one(p: Column) -> Column:
        u = F.get(units, p["first"])
        return F.when(p["kind"] == "text", text_piece(p)).when(p["kind"] == "slice", T.let(u, lambda x: slice_piece(p, x))).otherwise(T.let(u["group"], lambda g: table_piece(p, g)))

    return F.flatten(F.transform(ranges, one))


def chunk_sections(parts: DataFrame, limits: Limits | None = None, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Child chunks of sections (as ``sections`` gives them), one row each."""
    limits = limits or Limits()
    digest = fingerprint(limits, tokenizer.name)
    rows = parts.where(F.col("body").rlike(r"(?U)\S"))
    whole = lambda tokens: F.array(F.struct(
        F.array(_span(F.col("body_start"), F.col("body_end"))).alias("spans"), tokens.alias("tok"), F.lit(None).cast("string").alias("header"), F.col("body").alias("rendered"),
        F.lit(0).alias("overlap"), F.lit(0).alias("part"), F.lit(False).alias("cut")))
    packed = T.let(elements(F.col("body"), tokenizer, limits.most), lambda units: T.let(
        packed_ranges(units, F.col("body_start"), limits, tokenizer), lambda ranges: _pieces(units, ranges, limits, tokenizer)))
    # A body is counted once, here; a filter beside it would count it again.
    tokens = tokenizer.count(F.col("body")).cast("int")
    named = T.let(tokens, lambda n: F.when(n > 0, F.when((n <= limits.most) & ~T.has_table(F.col("body")), whole(n)).otherwise(packed)))
    with_ids = F.transform(named, lambda p: F.struct(p.alias("p"), chunk_id(F.col("document_version_id"), p["spans"], p["part"], digest).alias("id")))

    def linked(all_: Column) -> Column:
        """Each piece with the id its slices continue, and the id of the exception behind it."""
        return F.transform(all_, lambda x, i: F.struct(
            x["p"].alias("p"), x["id"].alias("id"), F.when(x["p"]["part"] > 0, F.get(all_, i - x["p"]["part"])["id"]).alias("of"),
            F.when(x["p"]["cut"], F.array(F.get(all_, i + 1)["id"])).otherwise(_none("string")).alias("exceptions")))

    rows = rows.select("document_version_id", "document_title", "section_id", "heading", "access_policy_id", "section_ordinal", F.posexplode(T.let(with_ids, linked)).alias("chunk_ordinal", "x"))
    rows = rows.select("*", F.col("x.p.rendered").alias("text"))
    return rows.select(
        F.col("x.id").alias("chunk_id"), F.col("section_id").alias("parent_id"), "document_version_id", "document_title", F.col("heading").alias("heading_path"), "text",
        F.col("x.p.spans").alias("spans"), "access_policy_id", F.col("x.p.tok").alias("token_count"), F.col("x.p.overlap").alias("overlap_tokens"),
        F.col("x.p.part").alias("part_index"), F.col("x.of").alias("continuation_of"), F.col("x.exceptions").alias("exception_refs"),
        T.references(F.col("text")).alias("reference_refs"), F.col("x.p.header").alias("table_header"),
        T.embedding_input(F.col("document_title"), F.col("heading"), F.col("text")).alias("embedding_input"),
        F.lit(digest).alias("chunker_config_hash"), "section_ordinal", "chunk_ordinal",
        F.get("x.p.spans", F.lit(0))["start"].alias("source_start"), F.element_at("x.p.spans", -1)["end"].alias("source_end"))


def chunk_documents(docs: DataFrame, limits: Limits | None = None, tokenizer: Tokenizer = WORDS) -> DataFrame:
    return chunk_sections(sections(docs), limits, tokenizer)


# ---------------------------------------------------------------- windows for a reranker


def source_spans(spans: Column, start: Column, end: Column) -> Column:
    """Where [start, end) of a chunk's text lies in the source, the text being the spans' texts with one character between them."""

    def add(a: Column, s: Column) -> Column:
        size = s["end"] - s["start"]
        low, high = F.greatest(start, a["at"]), F.least(end, a["at"] + size)
        one = F.array(_span(s["start"] + low - a["at"], s["start"] + high - a["at"]))
        return F.struct((a["at"] + size + 1).alias("at"), F.when(low < high, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), _none(SPAN).alias("out")), add, lambda a: a["out"])


def rerank_windows(pairs: DataFrame, limits: Limits | None = None, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """Windows of candidates that fit the scorer's pair limit beside their question and title, a row each.

    ``pairs``: chunk_id, question, document_title, heading_path, text, spans, and what else is to be kept; a
    row is one question with one candidate, and has a budget of its own.  A candidate that fits is one window
    under its own id; else whole sentences are packed, and a longer sentence is cut into slices that stand
    alone.  Adds window_index, window_id, window_text, window_spans (in the source), window_tokens and window_of.
    A table's rows are not slices of the source, so a window of a table has all of its chunk's spans, and so has
    the one window of an empty text.
    """
    limits = limits or Limits()
    title = F.concat_ws(" ", "document_title", "heading_path")
    budget = F.lit(limits.pair - limits.special) - tokenizer.count(F.col("question")) - tokenizer.count(title)
    rows = pairs.withColumn("_b", F.when(budget > 0, budget).otherwise(F.raise_error(F.lit("question and title leave no room")).cast("int")))
    text = F.col("text")

    def local(sentences: Column, most: Column) -> Column:
        """Spans in the candidate's text."""

        def step(a: Column, r: Column) -> Column:
            def with_text(t: Column) -> Column:
                stop, behind = a["at"] + F.length(t), a["at"] + F.length(r)
                flushed = F.when(a["start"] >= 0, F.concat(a["out"], F.array(_span(a["start"], a["end"])))).otherwise(a["out"])

                def state(start: Column, end: Column, tok: Column, joined: Column, out: Column) -> Column:
                    return F.struct(behind.alias("at"), start.alias("start"), end.alias("end"), tok.alias("tok"), joined.alias("text"), out.alias("out"))

                def placed(own: Column) -> Column:
                    carried = F.lit("") if tokenizer.additive else r
                    begun = state(a["at"], stop, own, carried, flushed)
                    grown = a["tok"] + own if tokenizer.additive else tokenizer.count(F.concat(a["text"], t)).cast("int")
                    after = F.lit("") if tokenizer.additive else F.concat(a["text"], r)
                    cut = F.transform(tokenizer.slices(t, most), lambda x: _span(a["at"] + x["start"], a["at"] + x["end"]))
                    return (
                        F.when(own > most, state(F.lit(-1), F.lit(0), F.lit(0), F.lit(""), F.concat(flushed, cut)))
                        .when((a["start"] >= 0) & (grown <= most), state(a["start"], stop, grown, after, a["out"]))
                        .otherwise(begun)
                    )

                blank = state(a["start"], a["end"], a["tok"], F.lit("") if tokenizer.additive else F.concat(a["text"], r), a["out"])
                return F.when(t == "", blank).otherwise(T.let(tokenizer.count(t).cast("int"), placed))

            return T.let(T.trim_end(r), with_text)

        zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("tok"), F.lit("").alias("text"), _none(SPAN).alias("out"))
        return F.aggregate(sentences, zero, step, lambda a: F.when(a["start"] >= 0, F.concat(a["out"], F.array(_span(a["start"], a["end"])))).otherwise(a["out"]))

    raw = F.filter(F.regexp_extract_all(text, F.lit(r"(?s).*?(?:" + T.SENTENCE_BREAK + r"|\z)"), F.lit(0)), lambda x: x != "")
    fits = tokenizer.count(text) <= F.col("_b")
    found = F.when(fits, F.array(_span(F.lit(0), F.length(text)))).otherwise(local(raw, F.col("_b")))
    # Made where it is exploded: by a column of its own Spark would first filter, and make all windows three times.
    placed = T.let(found, lambda w: F.transform(w, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.size(w).alias("n"))))
    rows = rows.select(*pairs.columns, F.posexplode(placed).alias("window_index", "_s"))
    start, end = F.col("_s.start"), F.col("_s.end")
    sliced = F.aggregate("spans", F.lit(-1), lambda a, s: a + s["end"] - s["start"] + 1) == F.length(text)
    name = F.when(F.col("_s.n") == 1, F.col("chunk_id").cast("string")).otherwise(F.concat_ws(":rerank:", F.col("chunk_id").cast("string"), F.col("window_index").cast("string")))
    shown = F.substring(text, start + 1, end - start)
    return rows.select(
        *pairs.columns, "window_index", name.alias("window_id"), shown.alias("window_text"),
        F.when(sliced & (start < end), source_spans(F.col("spans"), start, end)).otherwise(F.col("spans")).alias("window_spans"), tokenizer.count(shown).cast("int").alias("window_tokens"),
        F.when(F.col("window_index") > 0, F.concat(F.col("chunk_id").cast("string"), F.lit(":rerank:0"))).alias("window_of"))
