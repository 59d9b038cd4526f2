"""What a statement, a quote and a citation mark say about each other, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sedge.functions import claims as C, text as T
from sedge.operators.predicates import first_match

#: White space that ends a sentence's mark and is trimmed from quotes.
SPACE = " \t\n\x0b\x0c\r"
# Least and most characters of a quote, the least share of the most where a long one is cut at white space.
QUOTE_LEAST, QUOTE_MOST, QUOTE_CUT = 10, 900, 585
# Marks that a word before a full stop may carry.
QUOTE_MARKS = "\"'“”‘’()\\[\\]"


def sentence_parts(x: Column) -> Column:
    """x cut after each full stop, exclamation or question mark that white space follows, and between two line feeds; the parts join to x."""
    return F.split(x, r"(?<=[.!?])(?=\s)|(?<=\n)(?=\n)", -1)


def shortened(part: Column) -> Column:
    """Whether a part ends in an abbreviation: a full stop after one to three letters."""
    return part.rlike(rf"(?:^|\s)[{QUOTE_MARKS}]*(?:\p{{L}}[{QUOTE_MARKS}]*){{1,3}}\.$")


def bounded_pattern(most: int = QUOTE_MOST, cut: int = QUOTE_CUT) -> str:
    """Pieces of `most` characters at most, cut at the last white space from `cut` on, if there is one; white space between pieces belongs to none."""
    return rf"(?s)\S(?:.{{0,{most - 1}}}\z|.{{{cut - 1},{most - 1}}}(?=[ \n\t])|.{{{most - 1}}})"


# Words that count for no coverage; shares of statement, subject and outcome for direct and for partial support, the most that partial and none score.
COVERAGE_STOP = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "which", "with",
    "các", "có", "của", "đã", "được", "là", "một", "những", "trong", "và", "về", "với",
)
DIRECT, DIRECT_SUBJECT, DIRECT_OUTCOME = 0.62, 0.6, 0.55
PARTIAL, PARTIAL_SUBJECT, PARTIAL_OUTCOME, PARTIAL_MOST, NONE_MOST = 0.4, 0.5, 0.3, 0.6, 0.35


def coverage_words(x: Column) -> Column:
    """The different words of two characters or more but COVERAGE_STOP."""
    return F.array_except(T.token_set(x, 2), F.array(*map(F.lit, COVERAGE_STOP)))


def support(claim: Column, quote: Column) -> Column:
    """struct<direct, score, statement, subject, outcome> of a quote for a claim (a struct of statement, subject, outcome).

    A quote that holds the statement, or lies in it, supports it directly with 1.
    """
    statement, held = T.symbol_key(claim["statement"]), T.symbol_key(quote)
    shares = T.let(coverage_words(quote), lambda hay: F.struct(*[T.coverage(coverage_words(claim[c]), hay).alias(c) for c in ("statement", "subject", "outcome")]))

    def judged(s):
        most = F.greatest(s["statement"], (s["subject"] + s["outcome"]) / 2)
        direct = (s["statement"] >= DIRECT) | ((s["subject"] >= DIRECT_SUBJECT) & (s["outcome"] >= DIRECT_OUTCOME))
        exact = F.contains(held, statement) | F.contains(statement, held)
        return F.struct((exact | direct).alias("direct"), F.when(exact, F.lit(1.0)).otherwise(F.least(F.lit(1.0), most)).alias("score"), *[s[c].alias(c) for c in ("statement", "subject", "outcome")])

    return T.let(shares, judged)


def support_level(s: Column) -> Column:
    """direct, partial or none."""
    partial = (s["statement"] >= PARTIAL) | ((s["subject"] >= PARTIAL_SUBJECT) & (s["outcome"] >= PARTIAL_OUTCOME))
    return F.when(s["direct"], "direct").when(partial, "partial").otherwise("none")


def support_score(s: Column) -> Column:
    return first_match_value(support_level(s), {"direct": s["score"], "partial": F.least(F.lit(PARTIAL_MOST), s["score"])}, F.least(F.lit(NONE_MOST), s["score"]))


def first_match_value(level: Column, values: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for name, value in values.items():
        out = F.when(level == name, value).otherwise(out)
    return out


# Concepts that a claim and its citation must share; word boundaries bind the first and the last English word of each alone.
CITED_CONCEPTS = {
    "memory": r"\bmemory|memories|remember|recall\b|ký ức|trí nhớ|quá khứ",
    "future": r"\bfuture|prospective|anticipated|upcoming\b|tương lai|sắp tới|dự kiến",
    "stress": r"\bstress|anxiety|pressure|worry\b|căng thẳng|lo lắng|áp lực",
    "work": r"\bwork|job|project|presentation|meeting\b|công việc|dự án|trình bày|cuộc họp",
    "emotion": r"\bemotion|affect|feeling\b|cảm xúc|cảm giác",
    "creativity": r"\bcreative|creativity|divergent thinking\b|sáng tạo|linh hoạt",
    "threat": r"\bthreat|danger|fear\b|đe dọa|nguy hiểm|sợ hãi",
    "sleep": r"\bsleep|awakening|rem|nrem\b|giấc ngủ|tỉnh giấc",
}
# Characters before a mark that its claim lies in, least share of its concepts, least characters of an excerpt.
CLAIM_REACH, CONCEPT_SHARE, EXCERPT_LEAST = 700, 0.75, 60


def cited_concepts(x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(x.rlike(f"(?iu){p}"), F.lit(name)) for name, p in CITED_CONCEPTS.items()]))


def claim_before(tail: Column) -> Column:
    """The claim that ends with tail: what follows the last line feed or end mark of its last CLAIM_REACH characters, on one line."""
    last = F.regexp_replace(F.right(tail, F.lit(CLAIM_REACH)), r"(?s)^.*[\n.!?]", "")
    return F.trim(F.regexp_replace(last, r"\s+", " "))


def scope_of(excerpt: Column, *more: Column) -> Column:
    """What a citation says, made once: struct<concepts, enough>; enough where its excerpt is long enough to prove anything."""
    whole = F.concat_ws(" ", excerpt, *more)
    return F.struct(cited_concepts(whole).alias("concepts"), (F.length(F.trim(F.regexp_replace(F.coalesce(excerpt, F.lit("")), r"\s+", " "))) >= EXCERPT_LEAST).alias("enough"))


def cited(claim: Column, scope: Column) -> Column:
    """struct<claim, coverage, supported> of a claim and a scope_of: whether the citation shares most of the claim's concepts."""

    def judged(own):
        share = F.when(F.size(own) > 0, F.size(F.array_intersect(own, scope["concepts"])) / F.size(own)).otherwise(0.0)
        return F.struct(claim.alias("claim"), share.alias("coverage"), (scope["enough"] & (share >= CONCEPT_SHARE)).alias("supported"))

    return T.let(cited_concepts(claim), judged)


def checked(text: Column, citations: Column) -> Column:
    """struct<text, marks>: every mark [index] that its citation doesn't support reads [?].

    citations: array of structs (index, scope), taken in their order, each mark from left to right: a mark that was opened ends a sentence for
    those that come after it. marks: array of structs (index, place among that citation's, claim, coverage, supported).
    """

    def one(state, c):
        mark = F.concat(F.lit("["), c["index"].cast("string"), F.lit("]"))
        parts = F.split(state["text"], F.concat(F.lit(r"\["), c["index"].cast("string"), F.lit(r"\]")), -1)
        # The fold over the parts keeps the last characters alone, and for each mark what was found.
        begin = F.struct(F.right(F.get(parts, F.lit(0)), F.lit(CLAIM_REACH)).alias("tail"), F.slice(state["marks"], 1, 0).alias("found"))

        def step(acc, part):
            def moved(j):
                put = F.when(j["supported"], mark).otherwise("[?]")
                row = F.struct(c["index"].alias("index"), (F.size(acc["found"]) + 1).alias("place"), j["claim"].alias("claim"), j["coverage"].alias("coverage"), j["supported"].alias("supported"))
                return F.struct(F.right(F.concat(acc["tail"], put, part), F.lit(CLAIM_REACH)).alias("tail"), F.array_append(acc["found"], row).alias("found"))

            return T.let(cited(claim_before(acc["tail"]), c["scope"]), moved)

        def done(acc):
            marks = F.transform(acc["found"], lambda m: F.when(m["supported"], mark).otherwise("[?]"))
            pieces = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(marks, i - 1), p)))
            return F.struct(F.array_join(pieces, "").alias("text"), F.concat(state["marks"], acc["found"]).alias("marks"))

        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin, step, done)

    none = F.array().cast("array<struct<index:bigint,place:int,claim:string,coverage:double,supported:boolean>>")
    return F.aggregate(citations, F.struct(text.alias("text"), none.alias("marks")), one)


# Sentences that state no claim, of symbols, of one case, of advice, to a person; and what a claim must speak of.
NOT_CLAIMS = (
    r"^(?:dưới đây|sau đây) là (?:phần |một )?(?:phân tích|tóm tắt|giải thích)",
    r"^(?:phân tích|tóm tắt|kết luận|lời khuyên)(?: chi tiết)?\s*:?$",
    r"^(?:hãy|vui lòng) (?:cho tôi biết|chia sẻ|trả lời)",
    r"^(?:bạn có|do you|would you|can you)\b.*\?$",
    r"^(?:thay vì|hãy|bạn nên|lời khuyên|gợi ý hành động|try|consider|you should)\b",
    r"(?:tiềm thức (?:đang )?gợi ý|niềm tin tiềm ẩn|chìa khóa thành công|hướng bạn đến|tiếng nói nội tâm|được cấp [\"“]?phép đi)",
    r"(?:chim|biển|tàu|cây cầu|bàn phím|đồ chơi|mặt trăng)\s*:\s*(?:thường )?(?:tượng trưng|đại diện)",
    r"tượng trưng|biểu tượng của|đại diện cho|ám chỉ",
)
OF_THIS_CASE = r"\b(?:giấc mơ này|trong giấc mơ này|this dream|your dream)\b|^(?:giấc mơ|the dream)\s+(?:này\s+)?(?:thể hiện|phản ánh|cho thấy|gợi ý|reflects?|shows?|suggests?)\b|giấc mơ (?:đã )?cung cấp|manh mối|giải pháp (?:có thể )?nằm ở|dream (?:provides|offers)|the solution (?:may|might) lie"
PERSONAL, PERSON = r"\b(?:bạn|của bạn|your)\b", r"\b(?:bạn|của bạn|you|your)\b"
READS_INTO, SHOWS = r"phản ánh|cho thấy|minh họa|gợi ý|khuyến khích|reflect|suggest|indicat", r"phản ánh|cho thấy|minh họa|gợi ý|reflect|suggest|illustrat|indicat"
CASE_BEGINS, QUOTED = r"^(?:(?:trong mơ,?\s*)?việc\b|hình ảnh\b|(?:sự xuất hiện của|chi tiết|hình ảnh|việc)\b)", "[\"“”'][^\"“”']{2,}[\"“”']"
DREAMS, BRAIN, MEMORY = "giấc mơ|trong mơ|giấc ngủ|tỉnh giấc|dream|dreaming|sleep|awakening", "não bộ|brain", "ký ức|trí nhớ|memory|memories"
STRAIN, COPING = "lo lắng|căng thẳng|áp lực|anxiety|stress", "hành động|chuẩn bị|lập kế hoạch|giảm|giải tỏa|sáng tạo|action|planning|reduce|creative"
RELATES = "liên quan|kết hợp|tái kết hợp|đưa vào|xử lý|sử dụng|tăng|giảm|dẫn đến|thúc đẩy|ảnh hưởng|phổ biến|xuất hiện|associated|related|combine|incorporat|process|increase|decrease|predict|affect|common|prevalen|frequen|occur"
CLAIM_CONCEPTS = ("dream", "sleep", "memory", "waking_experience", "future", "anxiety", "creativity", "problem_solving")
CASE_SUBJECT = r"^(?:giấc mơ|the dream|this dream|your dream)\s+(?:này\s+|của bạn\s+)?(?:không nhất thiết\s+|does not necessarily\s+)?(?:diễn ra|xảy ra|bắt đầu|kết thúc|gợi ý|cho thấy|phản ánh|minh họa|takes place|occurs?|begins?|ends?|suggests?|shows?|reflects?|illustrates?)(?=$|[^\p{L}\p{N}])"
THIS_EVENT = r"^(?:sự|the)\s+(?:kết hợp|chuyển đổi|xuất hiện|biến mất|combination|transition|appearance|disappearance)\s+(?:này|this)(?=$|[^\p{L}\p{N}])"
IN_TURN, DREAM_SHOWS = r"^(?:khi|sau khi|trước khi|while|when|after|before)\b", r"(?:giấc mơ|dream)\b.*(?:gợi ý|cho thấy|phản ánh|suggests?|shows?|reflects?)"
CAUTIOUS = r"(?:^|[^\p{L}\p{N}])(?:có thể|có xu hướng|thường|nhìn chung|có khả năng|liên quan đến|được liên kết với|phổ biến hơn|ít phổ biến hơn|thay đổi đáng kể|may|might|can|could|tends? to|often|generally|is associated with|are associated with|is related to|are related to|more likely|less likely|more common|less common|var(?:y|ies|ied) significantly)(?=$|[^\p{L}\p{N}])"
REPORTS = r"(?:^|[^\p{L}\p{N}])(?:nghiên cứu|kết quả|dữ liệu|người tham gia|báo cáo|study|studies|results?|data|participants?|reports?)(?=$|[^\p{L}\p{N}])"
CHANGES = r"(?:^|[^\p{L}\p{N}])(?:tăng|giảm|cao hơn|thấp hơn|khác biệt|increase[ds]?|decrease[ds]?|higher|lower|differ(?:s|ed)?)(?=$|[^\p{L}\p{N}])"
CLAIM_LEAST, CLAIM_MOST = 35, 360


def claim_kind(x: Column) -> Column:
    """What a sentence is as a claim: none, researchable, or searchable: one that sources can be sought for, not an application to one case."""

    def of(clean, general):
        has = lambda p, c=clean: c.rlike(f"(?iu){p}")
        value, other = T.symbol_key(clean), T.symbol_key(general)
        own = value == other  # there is no more general sentence
        no_claim = (F.length(clean) < CLAIM_LEAST) | has(r"[?？]\s*$")
        for p in NOT_CLAIMS:
            no_claim = no_claim | has(p)
        quoted = F.size(F.regexp_extract_all(clean, F.lit(QUOTED), 0)) >= 2
        about_case = own & (has(OF_THIS_CASE) | (F.length(clean) > CLAIM_MOST) | has(PERSON) | ((has(CASE_BEGINS) | quoted) & has(SHOWS)))
        told = has(PERSONAL) & has(READS_INTO)
        concepts = F.size(F.array_compact(F.array(*[F.when(has(C.CONCEPTS[c]), F.lit(c)) for c in CLAIM_CONCEPTS])))
        field = has(DREAMS, value) | (has(BRAIN, value) & has(MEMORY, value)) | (has(STRAIN, value) & has(COPING, value)) | (concepts >= 2)
        claim = ~no_claim & ~about_case & ~told & has(RELATES, F.concat_ws(" ", value, other)) & field
        case = has(CASE_SUBJECT) | has(THIS_EVENT) | (has(IN_TURN) & has(DREAM_SHOWS))
        form = has(CAUTIOUS) | (has(REPORTS) & has(CHANGES))
        return first_match([("none", ~claim), ("searchable", ~own | (~case & form))], "researchable")

    return T.let(T.clean_claim(x), lambda clean: T.let(C.canonical(clean), lambda general: of(clean, general)))


# Least characters of a sentence that may be a claim; claims of one answer; likeness of a claim and the rule that grounds it.
SENTENCE_LEAST, MOST_CLAIMS, GROUNDED = 20, 8, 0.5


def claim_sentences(x: Column) -> Column:
    """An answer's different sentences that are claims, citation marks apart, the first MOST_CLAIMS of them; each as it is written."""
    long = F.filter(T.sentences(x), lambda s: F.length(s) >= SENTENCE_LEAST)
    keyed = F.transform(long, lambda s: F.struct(s.alias("claim"), F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*\[(?:\?|\d+)\]\s*", " "), r"\s+", " ")).alias("key")))
    claims = F.filter(keyed, lambda s: claim_kind(s["claim"]) != "none")
    first = lambda given: F.filter(given, lambda s, i: F.array_position(F.transform(given, lambda c: c["key"]), s["key"]) == i + 1)
    return F.slice(F.transform(T.let(claims, first), lambda s: s["claim"]), 1, MOST_CLAIMS)
