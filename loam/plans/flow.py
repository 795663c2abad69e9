"""Flows: question tables folded through named stages (DataFrame -> DataFrame), and the rules that repair a sketch of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import rules
from loam.functions.text import first_letter, focus_query, tokens
from loam.operators import index
from loam.operators.ordered import rotated
from loam.operators.search import bm25_topk, dense_topk, formula_search, ranked_top, rrf_fuse

# The stage names, in their canonical order.
STAGES = ["reformulate", "route", "focus", "search", "quota", "navigate", "rerank", "expand_parent", "child_context", "interleave", "formula", "gate", "critique", "respond"]
SEARCHES, CONTEXTS = {"search", "quota"}, {"expand_parent", "child_context", "interleave"}
VARIANTS = {
    "v0": ["respond"],
    "v1": ["search", "child_context", "respond"],
    "v2": ["search", "rerank", "expand_parent", "respond"],
    "v3": ["reformulate", "search", "rerank", "expand_parent", "respond"],
    "v4": ["reformulate", "search", "rerank", "expand_parent", "critique", "respond"],
    "v5": ["search", "rerank", "expand_parent", "gate", "respond"],
    "v6": ["search", "child_context", "gate", "respond"],
    "v7": ["reformulate", "search", "child_context", "gate", "respond"],
    "v8": ["route", "search", "child_context", "respond"],
    "v9": ["route", "search", "child_context", "formula", "respond"],
    "v10": ["route", "quota", "interleave", "respond"],
    "v11": ["route", "quota", "rerank", "interleave", "respond"],
    "v12": ["route", "quota", "expand_parent", "respond"],
    "v13": ["route", "focus", "quota", "interleave", "respond"],
    "v14": ["navigate", "respond"],
    "v15": ["reformulate", "quota", "interleave", "respond"],
    "v16": ["navigate", "respond"],
}
# Variants that fuse vectors with words, and all that look words up.
HYBRID = {"v2", "v3", "v4", "v5"}
WORD_SEARCH = HYBRID | {"v14", "v16"}


def repair(sketch: list[str]) -> list[str]:
    """Unknown stages go, a missing respond is appended, and a search without context gets parent expansion."""
    known = [s for s in sketch if s in STAGES and s != "respond"]
    if SEARCHES & set(known) and not CONTEXTS & set(known):
        known.append("expand_parent")
    return [*known, "respond"]


def canonical(sketch: list[str]) -> list[str]:
    """For proposed sketches: each stage once, in registry order; without a search only reformulate may stay."""
    found = [s for s in STAGES if s in sketch] + ([] if "respond" in sketch else ["respond"])
    return found if SEARCHES & set(found) else [s for s in found if s in ("reformulate", "respond")]


def _names(stages) -> F.Column:
    return F.array(*map(F.lit, stages)) if stages else F.array().cast("array<string>")


def repair_column(sketch: F.Column) -> F.Column:
    """``repair`` of each row's array of stage names."""
    known = F.filter(sketch, lambda s: s.isin([x for x in STAGES if x != "respond"]))
    bare = F.arrays_overlap(known, _names(sorted(SEARCHES))) & ~F.arrays_overlap(known, _names(sorted(CONTEXTS)))
    return F.concat(known, F.when(bare, _names(["expand_parent"])).otherwise(_names([])), _names(["respond"]))


def canonical_column(sketch: F.Column) -> F.Column:
    """``canonical`` of each row's array of stage names."""
    found = F.filter(_names(STAGES), lambda s: F.array_contains(sketch, s) | (s == "respond"))
    return F.when(F.arrays_overlap(found, _names(sorted(SEARCHES))), found).otherwise(F.filter(found, lambda s: s.isin("reformulate", "respond")))


def diagram_column(sketch: F.Column) -> F.Column:
    """``diagram`` of each row's array of stage names."""
    nodes = F.concat(_names(["__start__"]), repair_column(sketch), _names(["__end__"]))
    edges = F.zip_with(F.slice(nodes, F.lit(1), F.size(nodes) - 1), F.slice(nodes, F.lit(2), F.size(nodes) - 1), lambda a, b: F.concat(F.lit("\t"), a, F.lit(" --> "), b, F.lit(";")))
    return F.concat(F.lit("graph TD;\n"), F.array_join(edges, "\n"))


def answer_fields_column(mode: F.Column, anchoring: F.Column) -> F.Column:
    """``answer_fields`` of each row's mode and anchoring."""
    first = F.when(anchoring == "estrita", _names([])).when(anchoring == "falsificacao", _names(["erro_apontado"])).otherwise(_names(["ressalva"]))
    return F.concat(first, F.array(F.when(mode == "mcq", "letra").otherwise("resposta")), _names(["citacoes"]))


def accept_prompt_column(old: F.Column, new: F.Column) -> F.Column:
    return F.when((F.length(new) > 80) & (F.length(new) < 2500), new).otherwise(old)


def accept_prompt(old: str, new: str) -> str:
    """A proposed prompt replaces the old one only if its length is sensible."""
    return new if 80 < len(new) < 2500 else old


def best_sketch(history: DataFrame) -> DataFrame:
    """Of (step, sketch, score): the best score's first step, since only a better one replaces it."""
    return history.orderBy(F.desc("score"), "step").limit(1)


def best_steps(history: DataFrame, by: str) -> DataFrame:
    """``best_sketch`` of each ``by``: (by, step, score)."""
    best = F.max(F.struct("score", (-F.col("step")).alias("back"))).alias("x")
    return history.groupBy(by).agg(best).select(by, (-F.col("x.back")).alias("step"), "x.score")


def parsed_reply(mode: F.Column, reply: F.Column) -> F.Column:
    """(answer, citations, caveat) of a model's JSON reply; what can't be read is empty. A choice's answer is its first letter."""
    r = F.from_json(reply, "letra string, resposta string, ressalva string, erro_apontado string, citacoes array<struct<trecho string, pagina string>>")
    text = lambda x: F.coalesce(F.trim(x), F.lit(""))
    answer = F.when(mode == "mcq", first_letter(text(r["letra"]))).otherwise(text(r["resposta"]))
    return F.struct(answer.alias("answer"), F.coalesce(F.array_size(r["citacoes"]), F.lit(0)).alias("citations"), text(F.coalesce(r["ressalva"], r["erro_apontado"])).alias("caveat"))


def reply_terms(replies: DataFrame) -> DataFrame:
    """(id, term) of replies (id, reply): a line is a term, if it has 3 to 60 characters."""
    terms = replies.select("id", F.explode(F.split("reply", "\n")).alias("term")).select("id", F.trim("term").alias("term"))
    return terms.filter(F.length("term").between(3, 60))


def diagram(sketch: list[str]) -> str:
    """Mermaid text of a sketch."""
    nodes = ["__start__", *repair(sketch), "__end__"]
    return "\n".join(["graph TD;", *[f"\t{a} --> {b};" for a, b in zip(nodes, nodes[1:])]])


def answer_fields(mode: str, anchoring: str) -> list[str]:
    """Names of an answer's fields, in the order a model must fill them: what should weigh on the verdict stands before it."""
    first = {"estrita": [], "falsificacao": ["erro_apontado"]}.get(anchoring, ["ressalva"])
    return [*first, "letra" if mode == "mcq" else "resposta", "citacoes"]


def stub_client(prompt: str) -> str:
    """A deterministic stand-in for a model: V or F by the prompt's length."""
    return "V" if len(prompt) % 2 else "F"


def overlap(query, text):
    """A deterministic stand-in for a reranker: the share of the query's distinct words that the text holds."""
    q = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def _bound(value, body: Callable):
    """body(value), with the value worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def first_letters(text):
    """A deterministic stand-in for an embedding model: how often words begin with each letter from a to z, at length 1."""
    initials = F.array_join(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.substring(t, 1, 1)), "")
    counts = _bound(initials, lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(chr(97 + i))))).cast("double") for i in range(26)]))
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    return _bound(counts, lambda v: _bound(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def dense_search(embed: Callable = first_letters) -> Callable:
    """A searcher by embedded texts: exact inner products above 0."""
    side = lambda df, key: df.select(key, embed(F.col("text")).alias("vector"))
    return lambda docs, queries, k: dense_topk(side(docs, "id"), side(queries, "qid"), k).filter("score > 0")


def indexed_search(path: str) -> Callable:
    """A searcher by words in the inverted index of all documents."""
    return lambda docs, queries, k: index.search(docs.sparkSession, path, queries, k)


def hybrid_search(embed: Callable = first_letters, words: Callable = bm25_topk) -> Callable:
    """A searcher that fuses the ranks of a dense one and of BM25, each as deep as what is asked for."""
    dense = dense_search(embed)
    return lambda docs, queries, k: rrf_fuse([words(docs, queries, k), dense(docs, queries, k)], k)


def searcher_of(variant: str, path: str | None = None, embed: Callable = first_letters) -> Callable:
    """How a variant searches: by vectors, but for those that fuse vectors with words, and the walks, which look words up; only these need an index."""
    if variant not in WORD_SEARCH:
        return dense_search(embed)
    words = indexed_search(path)
    return hybrid_search(embed, words) if variant in HYBRID else words


def glossary(words: dict[str, str]) -> Callable:
    """A stand-in for a model that rewords or translates: whole words are exchanged, one after the other."""

    def reword(query):
        for old, new in words.items():
            query = F.regexp_replace(query, rf"(?<![\p{{L}}\p{{N}}_]){old}(?![\p{{L}}\p{{N}}_])", new)
        return query

    return reword


def covers(least: float) -> Callable:
    """A stand-in for a judge: whether the context holds at least this share of the question's words."""
    return lambda question, context: overlap(question, context) >= least


@dataclass
class Options:
    """What a flow may be given instead of the stand-ins."""

    k: int = 8
    k_search: int = 20
    rounds: int = 4
    client: Callable[[str], str] = stub_client
    searcher: Callable = bm25_topk
    scorer: Callable = overlap
    reword: Callable = lambda query: query
    on_topic: Callable = field(default_factory=lambda: covers(0.01))
    suffices: Callable = field(default_factory=lambda: covers(0.5))
    formulas: DataFrame | None = None
    #: A model's JSON reply for questions that no rule places; without one they get the last topic.
    classify: Callable = lambda question: F.lit(None).cast("string")


@dataclass
class State:
    """asked: qid, text, query, topic. ranked: qid, id, source, rank, score. context: qid, slot, id, text, source. support: qid, support."""

    asked: DataFrame
    docs: DataFrame
    ranked: DataFrame | None = None
    context: DataFrame | None = None
    support: DataFrame | None = None
    trace: tuple = ()
    #: Whether what all questions have found is few rows: these are broadcast then, and no text is moved to meet them.
    few: bool = False


def _found(s: State, rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if s.few else rows


def _queries(s: State) -> DataFrame:
    return s.asked.select("qid", F.col("query").alias("text"))


def _is_normative():
    return F.coalesce(F.col("topic"), F.lit("")).isin(rules.NORMATIVE)


def _of(s: State, source: str) -> DataFrame:
    return s.docs.filter(F.col("source") == source)


def _reformulate(s: State, o: Options) -> State:
    short = F.substring(F.trim(F.regexp_replace(o.reword(F.col("query")), r"\s+", " ")), 1, 400)
    return replace(s, asked=s.asked.withColumn("query", F.when(short != "", short).otherwise(F.col("text"))))


def _route(s: State, o: Options) -> State:
    return replace(s, asked=s.asked.withColumn("topic", F.coalesce(rules.topic_by_rule(F.col("text"), F.lit("")), rules.topic_of_reply(o.classify(F.col("text"))))))


def _focus(s: State, o: Options) -> State:
    return replace(s, asked=s.asked.withColumn("query", F.when(F.contains("text", F.lit("\n\nAssertiva:")), focus_query(F.col("text"))).otherwise(F.col("query"))))


def _search(s: State, o: Options) -> State:
    if "route" not in s.trace:
        return replace(s, ranked=o.searcher(s.docs, _queries(s), o.k_search).withColumn("source", F.lit("all")))
    sides = [("norms", _is_normative()), ("book", ~_is_normative())]
    found = [o.searcher(_of(s, name), _queries(replace(s, asked=s.asked.filter(to))), o.k_search).withColumn("source", F.lit(name)) for name, to in sides]
    return replace(s, ranked=found[0].unionByName(found[1]))


def _quota(s: State, o: Options) -> State:
    """Normative questions get half of the places from each source, others all from the book."""
    half = max(1, o.k_search // 2)
    norms = o.searcher(_of(s, "norms"), _queries(replace(s, asked=s.asked.filter(_is_normative()))), half)
    book = o.searcher(_of(s, "book"), _queries(s), o.k_search).join(s.asked.select("qid", _is_normative().alias("n")), "qid").filter(~F.col("n") | (F.col("rank") <= half)).drop("n")
    return replace(s, ranked=norms.withColumn("source", F.lit("norms")).unionByName(book.withColumn("source", F.lit("book"))))


def _rerank(s: State, o: Options) -> State:
    """The k best by the scorer; sources are kept, ranks run over all of a question's candidates."""
    pairs = _found(s, s.ranked.select("qid", "id", "source")).join(s.docs.select("id", "text"), "id").join(_queries(s).withColumnRenamed("text", "query"), "qid")
    scored = pairs.select("qid", "id", "source", o.scorer(F.col("query"), F.col("text")).alias("score"))
    return replace(s, ranked=ranked_top(scored, o.k))


def _with_texts(s: State, picked: DataFrame) -> State:
    """picked: qid, slot, id, source."""
    return replace(s, context=_found(s, picked).join(s.docs.select("id", "text"), "id").select("qid", "slot", "id", "text", "source"))


def _turns(ranked: DataFrame, k: int) -> DataFrame:
    """Norms and book in turn, norms first; the first k."""
    turn = F.row_number().over(Window.partitionBy("qid", "source").orderBy("rank", "id"))
    slot = F.row_number().over(Window.partitionBy("qid").orderBy("turn", F.desc("source"), "id")).cast("long")
    return ranked.withColumn("turn", turn).withColumn("slot", slot).filter(F.col("slot") <= k)


def _child_context(s: State, o: Options) -> State:
    return _with_texts(s, s.ranked.filter(F.col("rank") <= o.k).select("qid", F.col("rank").alias("slot"), "id", "source"))


def _expand_parent(s: State, o: Options) -> State:
    """Each candidate's parent, once, where its best child stood; a document without a parent is its own."""
    chosen = _turns(s.ranked, o.k) if "quota" in s.trace else s.ranked.filter(F.col("rank") <= o.k).withColumn("slot", F.col("rank"))
    if "parent" not in s.docs.columns:
        return _with_texts(s, chosen.select("qid", "slot", "id", "source"))
    owner = s.docs.select("id", F.coalesce("parent", "id").alias("owner"))
    return _with_texts(s, _found(s, chosen).join(owner, "id").groupBy("qid", F.col("owner").alias("id")).agg(F.min("slot").alias("slot"), F.min_by("source", "slot").alias("source")).select("qid", "slot", "id", "source"))


def _interleave(s: State, o: Options) -> State:
    return _with_texts(s, _turns(s.ranked, o.k).select("qid", "slot", "id", "source"))


def _joined(s: State) -> DataFrame:
    """(qid, context, n_context): a question's texts, in order, as one."""
    rows = F.array_sort(F.collect_list(F.struct("slot", "id", "text")))
    return s.context.groupBy("qid").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("context"), F.count("*").alias("n_context"))


def _judged(s: State, judge: Callable) -> DataFrame:
    """qid and whether the judge, given question and context, says yes; nothing is no."""
    both = s.asked.select("qid", "text").join(_joined(s), "qid", "left")
    return both.select("qid", F.coalesce(F.col("context").isNotNull() & judge(F.col("text"), F.col("context")), F.lit(False)).alias("yes"))


def _gate(s: State, o: Options) -> State:
    """A context off the question's topic is dropped whole."""
    return replace(s, context=s.context.join(_judged(s, o.on_topic).filter("yes").select("qid"), "qid", "left_semi"))


def _critique(s: State, o: Options) -> State:
    """Questions whose context doesn't suffice are searched once more, with the question as it was put and twice the depth."""
    verdict = _judged(s, o.suffices)
    enough, short = (verdict.filter(x).select("qid") for x in ("yes", "not yes"))
    # All are searched again and only the short ones kept: a searcher that reads its queries first need not run what came before.
    again = replace(s, asked=s.asked.withColumn("query", F.col("text")), ranked=None, context=None)
    again = _search(again, replace(o, k_search=2 * o.k_search))
    again = _expand_parent(_rerank(replace(again, ranked=again.ranked.join(short, "qid", "left_semi")), o), o)
    return replace(s, context=s.context.join(enough, "qid", "left_semi").unionByName(again.context))


def _navigate(s: State, o: Options) -> State:
    """A bounded walk over the library, for all questions at once: the first round searches, each further one reads on in the
    source of the question's best hit. A question stops after the first round with which its context suffices; what was read
    before isn't read again.

    What a question has read by a round doesn't depend on when others stop, so that one pass judges all rounds.
    """
    each, most = max(1, o.k // 2), max(o.k, 8)
    deep = _found(s, o.searcher(s.docs.select("id", "text"), _queries(s), each * o.rounds)).join(s.docs.select("id", "source", "text"), "id")
    home = F.first("source").over(Window.partitionBy("qid").orderBy("rank"))
    walk = deep.withColumn("round", F.when(F.col("rank") <= each, 1).when(F.col("source") == home, F.ceil(F.col("rank") / each)).cast("int")).filter(F.col("round").isNotNull())
    walk = walk.withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long")).filter(F.col("slot") <= most)
    read = s.asked.select("qid", "text").join(walk.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", "id", "round", "source", F.col("text").alias("t")))).alias("rows")), "qid")
    by = lambda r: F.array_join(F.transform(F.filter("rows", lambda x: x["round"] <= r), lambda x: x["t"]), "\n")
    stop = F.coalesce(*[F.when(o.suffices(F.col("text"), by(r)), r) for r in range(1, o.rounds)], F.lit(o.rounds))
    picked = read.select("qid", stop.alias("stop"), "rows").select("qid", "stop", F.explode("rows").alias("x")).filter(F.col("x.round") <= F.col("stop"))
    return replace(s, context=picked.select("qid", "x.slot", "x.id", F.col("x.t").alias("text"), "x.source"))


def _formula(s: State, o: Options) -> State:
    """The two best entries of the formulary, as support that isn't quoted."""
    if o.formulas is None:
        return s
    best = formula_search(o.formulas, s.asked.select("qid", "text"), 2).join(o.formulas.select("id", F.concat_ws(": ", "name", "expression").alias("entry")), "id")
    return replace(s, support=best.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n\n").alias("support")))


RUN = {
    "reformulate": _reformulate, "route": _route, "focus": _focus, "search": _search, "quota": _quota, "navigate": _navigate, "rerank": _rerank,
    "expand_parent": _expand_parent, "child_context": _child_context, "interleave": _interleave, "formula": _formula, "gate": _gate, "critique": _critique,
}


def _step(options: Options):
    def step(s: State, stage: str) -> State:
        return replace(RUN[stage](s, options), trace=(*s.trace, stage))

    return step


def run_flow(questions: DataFrame, docs: DataFrame, sketch: list[str], options: Options | None = None) -> DataFrame:
    """questions (qid, text), docs (id, text, source: book or norms[, parent]) -> qid, n_context, answer, trace.

    Every stage is one plan over all questions; only the answers call the client, in mapInPandas.
    """
    options, stages = options or Options(), repair(sketch)
    most = max(4 * options.k_search, max(1, options.k // 2) * options.rounds)  # rows a question, at any stage
    few = stages != ["respond"] and questions.count() * most <= index.BROADCAST_ROWS
    start = State(questions.select("qid", "text", F.col("text").alias("query"), F.lit(None).cast("string").alias("topic")), docs, few=few)
    end = reduce(_step(options), stages[:-1], start)
    prompts = questions.select("qid", "text")
    prompts = prompts.join(_joined(end), "qid", "left") if end.context is not None else prompts.withColumn("context", F.lit(None).cast("string")).withColumn("n_context", F.lit(0))
    prompts = prompts.join(end.support, "qid", "left") if end.support is not None else prompts.withColumn("support", F.lit(None).cast("string"))
    prompts = prompts.select("qid", F.concat_ws("\n\n", "context", "support", "text").alias("prompt"), F.coalesce("n_context", F.lit(0)).cast("long").alias("n_context"))
    client = options.client

    def respond(batches):
        for pdf in batches:
            yield pdf.assign(answer=[client(p)[:1].upper() for p in pdf["prompt"]])[["qid", "n_context", "answer"]]

    kind = questions.schema["qid"].dataType.simpleString()
    return prompts.mapInPandas(respond, f"qid {kind}, n_context long, answer string").withColumn("trace", F.lit(">".join(stages)))


def answered(prompts: DataFrame, client: Callable[[str], str] = stub_client) -> DataFrame:
    """``prompts`` (..., prompt) with ``answer``, the first letter of the client's reply."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(answer=[client(p)[:1].upper() for p in pdf["prompt"]])

    return prompts.mapInPandas(run, f"{kinds}, answer string")


def perturbed(questions: DataFrame, contexts: DataFrame, client: Callable[[str], str] = stub_client) -> DataFrame:
    """(scenario, n, accuracy) of questions (qid, text, key) answered with their own context (qid, context), with the next question's, and with none.

    The next question is found by rank over all of them, the last one's is the first; all three are answered in one pass.
    """
    swap = rotated(questions, "qid")
    own = questions.join(contexts, "qid", "left").select("qid", "text", "key", "context", F.lit("right").alias("scenario"))
    other = questions.join(swap, "qid").join(contexts.select(F.col("qid").alias("other"), "context"), "other", "left").select("qid", "text", "key", "context", F.lit("swapped").alias("scenario"))
    none = questions.select("qid", "text", "key", F.lit(None).cast("string").alias("context"), F.lit("empty").alias("scenario"))
    prompts = own.unionByName(other).unionByName(none).select("scenario", "key", F.concat_ws("\n\n", "context", "text").alias("prompt"))
    right = (F.col("answer") == F.col("key")).cast("int")
    return answered(prompts, client).groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.avg(right), 9).alias("accuracy"))
