"""Claims as Columns: their language, signs, canonical form, key and likeness, in Vietnamese and English."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sedge.functions import text as T
from sedge.operators.predicates import first_match

# Words that say nothing in a claim's key.
STOP = "khi của và là thì trong những được một này bạn có cho với the and that this from with when into".split()
# What tells Vietnamese from English in a claim, and in a query.
VIETNAMESE_MARKS = "ăâđêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"
QUERY_MARKS, QUERY_ENGLISH = "ăâđêôơưàáảãạéèẻẽẹíìỉĩịóòỏõọúùủũụýỳỷỹỵ", r"(?i)\b(?:the|and|dream|sleep|memory|fear)\b"
VIETNAMESE_WORDS = r"giấc mơ|trong mơ|ký ức|tương lai|lo âu|sáng tạo"
# Concepts of both languages, and those of which a common pair must hold one.
CONCEPTS = {
    "dream": "giấc mơ|trong mơ|mộng|dream|dreaming",
    "sleep": "giấc ngủ|khi ngủ|tỉnh giấc|sleep|awakening",
    "memory": "ký ức|trí nhớ|mảnh nhớ|thời thơ ấu|memory|memories|childhood",
    "waking_experience": "khi thức|đời sống thức|trải nghiệm ban ngày|waking(?:-life)?|daytime experience",
    "future": "tương lai|sắp tới|dự kiến|nhiệm vụ tương lai|future|prospective|anticipated|upcoming",
    "anxiety": "lo âu|lo lắng|căng thẳng|áp lực|sợ hãi|anxiety|stress|pressure|fear",
    "creativity": "sáng tạo|linh hoạt|ứng biến|tư duy phân kỳ|creative|flexib|improvis|divergent",
    "problem_solving": "giải quyết vấn đề|phương án|giải pháp|problem.solving|solution|alternative",
    "action_planning": "hành động|chuẩn bị|lập kế hoạch|action|prepar|planning",
    "stress_reduction": "giảm căng thẳng|giải tỏa|nhẹ nhõm|tan biến|stress reduction|relief|decreas",
    "work_project": "công việc|dự án|lịch họp|buổi trình bày|work|project|meeting|presentation",
    "intrusion": "xâm lấn|mang.+vào giấc ngủ|không gian nghỉ ngơi|intrud|spillover|carry.+sleep",
    "weak_association": "liên kết yếu|kết nối xa|weak association|remote association",
}
ANCHORS = "memory future anxiety creativity problem_solving action_planning stress_reduction work_project weak_association".split()
# Signs that decide the canonical form, and those that decide the key.
LATE = r"cuối đêm|gần sáng|(?:phần\s+)?cuối(?:\s+của)?\s+giấc ngủ|later in the night|later in the sleep period|late in sleep|final quartile"
CONSTRUCTION = r"tái kết hợp|kết hợp.+(?:cấu trúc|kịch bản)|xây dựng.+kịch bản|mô phỏng.+tương lai|recombin|construct.+(?:scenario|future)|future simulation"
COMMON_SIGNS = {
    "memory": "ký ức|trí nhớ|thời thơ ấu|memory|memories|childhood",
    "creativity": "sáng tạo|linh hoạt|ứng biến|giải pháp|tư duy phân kỳ|creative|flexib|improvis|solution|divergent",
    "action": "hành động|chuẩn bị|lập kế hoạch|action|prepar|planning",
    "weak": "liên kết yếu|kết nối xa|weak association|remote association",
    "late": LATE,
    "processing": "xử lý thông tin|information processing",
    "construction": CONSTRUCTION,
}
CANONICAL_SIGNS = COMMON_SIGNS | {
    "dream": "giấc mơ|trong mơ|giấc ngủ|dream|dreaming|sleep",
    "brain": "não bộ|brain",
    "future": "tương lai|sắp tới|trách nhiệm|nhiệm vụ hiện tại|future|prospective|upcoming",
    "anxiety": "lo âu|lo lắng|căng thẳng|áp lực|anxiety|stress|pressure",
    "reduction": "giảm|giải tỏa|tan biến|reduce|relief|decreas",
    "insight": "bất ngờ|tìm ra giải pháp|khoảnh khắc sáng tỏ|surpris|insight|eureka",
}
KEY_SIGNS = COMMON_SIGNS | {
    "dream": "giấc mơ|trong mơ|giấc ngủ|dream|sleep",
    "future": "tương lai|sắp tới|future|prospective|anticipated",
    "anxiety": "lo âu|lo lắng|căng thẳng|áp lực|sợ hãi|anxiety|stress|pressure|fear",
    "reduction": "giảm|giải tỏa|tan biến|reduce|reduction|relief|decreas",
    "work": "công việc|dự án|lịch họp|buổi trình bày|work|project|meeting",
    "intrusion": "xâm lấn|mang.+vào giấc ngủ|không gian nghỉ ngơi|intrud|spillover|carry.+sleep",
    "insight": "bất ngờ|sáng tỏ|tìm ra giải pháp|surpris|insight|eureka",
}
# Canonical sentences (Vietnamese, English) by the signs they need; the first whose signs are all there (of those with | one) counts.
CANONICAL = (
    ("dream future late", "Giấc mơ hướng tới tương lai có thể trở nên phổ biến hơn vào phần cuối của giấc ngủ.", "Future-oriented dreams may become more common later in the sleep period."),
    ("dream weak creativity", "Kích hoạt các liên kết yếu trong giấc mơ có thể liên quan đến tư duy sáng tạo, linh hoạt hoặc phân kỳ.", "Activation of weak associations in dreams may be related to creative, flexible, or divergent thinking."),
    ("dream insight processing", "Xử lý thông tin trong giấc ngủ có thể liên quan đến cảm giác sáng tỏ hoặc bất ngờ khi tỉnh dậy.", "Information processing during sleep may be associated with insight or surprise upon awakening."),
    ("memory|construction dream|brain future", "Nội dung giấc mơ có thể tái kết hợp ký ức quá khứ với mối quan tâm hoặc nhiệm vụ tương lai.", "Dream content may recombine past memories with future concerns or anticipated tasks."),
    ("memory dream|brain", "Nội dung giấc mơ có thể tái kết hợp các mảnh ký ức từ trải nghiệm khi thức.", "Dream content may recombine memory fragments from waking experience."),
    ("dream anxiety creativity", "Lo âu trong giấc mơ có thể liên quan đến việc thử nghiệm các phương án giải quyết vấn đề sáng tạo.", "Anxiety in dreams may be associated with exploring creative problem-solving alternatives."),
    ("anxiety action reduction", "Chuyển lo âu thành hành động hoặc kế hoạch cụ thể có thể liên quan đến việc giảm căng thẳng.", "Turning anxiety into concrete action or planning may be associated with reduced stress."),
)
# Keys of relations by the signs of the canonical form.
KEYS = (
    ("action anxiety reduction", "relation:action-planning__outcome:stress-reduction"),
    ("dream future late", "context:late-sleep__outcome:future-oriented-dream-prevalence"),
    ("dream weak creativity", "mechanism:weak-association__outcome:creative-divergent-thinking"),
    ("dream insight processing", "mechanism:sleep-information-processing__outcome:insight-or-surprise"),
    ("memory|construction dream future", "mechanism:memory-recombination__context:future-oriented-dream"),
    ("memory dream", "mechanism:memory-incorporation__context:dream"),
    ("work anxiety intrusion|dream|memory", "context:work-pressure__outcome:sleep-or-memory-intrusion"),
    ("anxiety creativity", "state:anxiety__outcome:creative-coping-or-improvisation"),
)
# Likeness of claims with one key, the most of those whose relations differ, base, span and most of concepts.
SAME_KEY, OTHER_RELATION, CONCEPT_BASE, CONCEPT_SPAN, CONCEPT_MOST = 0.72, 0.24, 0.24, 0.44, 0.68


def _joined(words: Column) -> Column:
    return F.array_join(F.array_sort(F.array_except(words, F.array(*map(F.lit, STOP)))), " ")


def fingerprint(x: Column) -> Column:
    """The claim's different words of three characters or more but STOP, sorted, as one string."""
    return _joined(T.token_set(T.clean_claim(x)))


def _decided(x: Column, signs: dict[str, str], table, result, otherwise: Column) -> Column:
    """The result of the first row whose signs show in x, each pattern tried once."""
    shown = F.array_compact(F.array(*[F.when(x.rlike(f"(?iu){p}"), F.lit(name)) for name, p in signs.items()]))

    def chosen(have):
        out = otherwise
        for row in reversed(table):
            needs = [F.arrays_overlap(have, F.array(*map(F.lit, group.split("|")))) for group in row[0].split()]
            holds = needs[0]
            for n in needs[1:]:
                holds = holds & n
            out = F.when(holds, result(row)).otherwise(out)
        return out

    return T.let(shown, chosen)


def _canonical(clean: Column) -> Column:
    vietnamese = clean.rlike(f"(?iu)[{VIETNAMESE_MARKS}]") | clean.rlike(rf"(?i)\b(?:{VIETNAMESE_WORDS})\b")
    return _decided(T.symbol_key(clean), CANONICAL_SIGNS, CANONICAL, lambda row: F.when(vietnamese, row[1]).otherwise(row[2]), clean)


def canonical(x: Column) -> Column:
    """The general sentence that a claim is a case of, in its language; the cleaned claim where there is none."""
    return T.let(T.clean_claim(x), _canonical)


def prepared(x: Column) -> Column:
    """What similarity compares, made once for each claim: its words, those of its canonical form, its concepts and its key."""

    def of(clean, general):
        concepts = F.array_compact(F.array(*[F.when(clean.rlike(f"(?iu){p}"), F.lit(name)) for name, p in CONCEPTS.items()]))
        key = T.let(T.token_set(clean), lambda words: _decided(T.symbol_key(general), KEY_SIGNS, KEYS, lambda row: F.lit(row[1]), _joined(words)))
        return F.struct(T.token_set(clean).alias("words"), T.token_set(general).alias("canonical"), concepts.alias("concepts"), key.alias("key"))

    return T.let(T.clean_claim(x), lambda clean: T.let(T.clean_claim(_canonical(clean)), lambda general: of(clean, general)))


def cluster_key(x: Column) -> Column:
    """The key of the relation that a claim states, or its fingerprint."""
    return prepared(x)["key"]


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two prepared claims: of words, of canonical forms, of concepts or of keys; little where one's relation isn't the other's."""
    shared = F.array_intersect(a["concepts"], b["concepts"])
    fewest = F.least(F.size(a["concepts"]), F.size(b["concepts"]))
    enough = (F.size(shared) >= 2) & F.arrays_overlap(shared, F.array(*map(F.lit, ANCHORS)))
    concepts = F.when(enough, F.least(F.lit(CONCEPT_MOST), CONCEPT_BASE + F.size(shared) / fewest * CONCEPT_SPAN)).otherwise(0.0)
    plain = F.greatest(T.overlap(a["words"], b["words"]), T.overlap(a["canonical"], b["canonical"]), concepts)
    related = F.contains(a["key"], F.lit("__")) | F.contains(b["key"], F.lit("__"))
    same = a["key"] == b["key"]
    return F.when(related & ~same, F.least(F.lit(OTHER_RELATION), plain)).when(same & (a["key"] != ""), F.greatest(plain, F.lit(SAME_KEY))).otherwise(plain)


def query_language(x: Column) -> Column:
    return first_match([("vi", x.rlike(f"(?iu)[{QUERY_MARKS}]")), ("en", x.rlike(QUERY_ENGLISH))], "unknown")


# Features of a text, the terms each adds to a search, and what past and future together add.
FEATURES = {
    "past_time": (r"hôm\s+qua|trước\s+đây|ngày\s+xưa|quá\s+khứ|tuổi\s+thơ|đã\s+từng|cũ|yesterday|previously|formerly|past|childhood|ago", "past events, past episode, past event reference, autobiographical memory, recent events"),
    "future_time": (r"ngày\s+mai|tuần\s+tới|tháng\s+tới|năm\s+sau|sắp\s+tới|tương\s+lai|sẽ|dự\s+định|tomorrow|upcoming|next\s+(?:week|month|year)|future|anticipated|prospective", "future events, future anticipation, future-oriented dreams, prospective dreams, upcoming events, general future concerns"),
    "multiple_future_horizons": (r"(?:ngày\s+mai|tuần\s+tới|tomorrow|next\s+week)[\s\S]{0,180}(?:tháng\s+tới|năm\s+sau|tương\s+lai|next\s+(?:month|year)|months?\s+from\s+now|future)", "future event combination, multiple time points, temporal proximity"),
    "implausible_transformation": (r"biến\s+thành|hóa\s+thành|phi\s+lý|không\s+thể|lơ\s+lửng|bay|transform(?:ed|s|ing)?|impossible|implausible|unrealistic|floating|flying", "implausible scenarios, weak associations, unrealistic dream content"),
    "late_sleep_period": (r"gần\s+sáng|cuối\s+đêm|về\s+sáng|near\s+dawn|late\s+in\s+the\s+night|toward\s+morning", "later in the night, time of night, temporal orientation"),
    "memory_process": (r"quên|nhớ|ký\s+ức|trí\s+nhớ|hồi\s+ức|forget(?:ting)?|remember(?:ed|ing)?|memory|recall", "memory, forgetting, memory consolidation, memory reactivation"),
    "threat_or_fear": (r"đuổi|rượt|chạy\s+trốn|sợ|hoảng|đe\s+dọa|chase(?:d|s|ing)?|pursu(?:e|ed|ing|it)|fear|panic|threat", "threat, anxiety, avoidance, threat simulation"),
}
PAST_AND_FUTURE = "past and future events, episodic sources"
SEARCH_STOP = "the and that this for with from into than are was were can may will của và cho với trong những một này được các như bởi tại trên dưới".split()
# Conditions that never apply, or only with a feature of the query.
NEVER, LATE_NIGHT, HORIZONS = r"\b(?:awakening\s+latency|độ\s+trễ\s+tỉnh\s+giấc)\b", r"\b(?:later|late)\s+in\s+the\s+night\b", r"\b(?:different|multiple)\s+time\s+points?\b"
# Weights of a rule's score, and the least overlap of one that is shown.
TAGS, LEXICAL, STATEMENT, VECTOR, EVIDENCE, GATE = 0.4, 0.23, 0.12, 0.15, 0.1, 0.1


def features(x: Column) -> Column:
    """The names of the features that a text shows."""
    return F.array_compact(F.array(*[F.when(F.lower(x).rlike(f"(?iu)(?:{p})"), F.lit(name)) for name, (p, _) in FEATURES.items()]))


def expanded(x: Column) -> Column:
    """A text with the search terms of its features."""
    terms = F.array_compact(F.array(*[F.when(F.array_contains(features(x), name), F.lit(t)) for name, (_, t) in FEATURES.items()]))
    both = F.array_contains(features(x), "past_time") & F.array_contains(features(x), "future_time")
    return F.concat_ws(" ", x, F.when(F.size(terms) > 0, F.concat_ws(" ", F.lit("retrieval features"), F.array_join(terms, ", "))), F.when(both, F.lit(PAST_AND_FUTURE)))


def content(x: Column) -> Column:
    return T.content_words(x, SEARCH_STOP)


def applicable(conditions: Column, have: Column) -> Column:
    """Whether a rule's conditions may hold for a text with these features."""
    c = F.lower(F.concat_ws(" ", conditions))
    return F.when(c.rlike(f"(?iu){NEVER}"), False).when(c.rlike(f"(?iu){LATE_NIGHT}"), F.array_contains(have, "late_sleep_period")).when(
        c.rlike(f"(?iu){HORIZONS}"), F.array_contains(have, "multiple_future_horizons")
    ).otherwise(True)


# Words left out before rules are compared, prefixes and endings of negated adjectives.
RULE_STOP = "a an and are as at be by for from in is of on or that the to with các có của do được là một những ở theo trong và với".split()
# Least likeness of subject and outcome for one direction, of conditions, of words in tension, of subject and of statements that add to each other.
SAME, CONDITION, TENSION, SUBJECT, STATEMENTS = 0.65, 0.25, 0.08, 0.45, 0.38


def stems(x: Column) -> Column:
    """The different stems of a text, two characters or more, but RULE_STOP."""
    return F.array_distinct(F.filter(F.transform(T.words(x), T.stem), lambda w: (F.length(w) >= 2) & ~w.isin(RULE_STOP)))


def negated(stem: Column) -> Column:
    """Whether a stem is an adjective with a negating prefix before a base of four letters or more."""
    bases = [stem.rlike(rf"^{p}(?=.*[aeiouy]).{{4,}}$") for p in ("counter", "non", "dis", "im", "in", "ir", "il", "un")]
    any_base = bases[0]
    for b in bases[1:]:
        any_base = any_base | b
    return any_base & stem.rlike("(?:able|ible|ive|al|ary|ous|ent|ant|ic)$")


def _alike(a: Column, b: Column) -> Column:
    """Equal, or with a common beginning of five letters or more that is three quarters of the shorter."""
    n = F.greatest(F.lit(5), F.ceil(F.least(F.length(a), F.length(b)) * 0.75)).cast("int")
    return (a == b) | ((F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))


def fuzzy_jaccard(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of stems, each of a matched with the first one of b left that is alike."""

    def step(left, x):
        at = F.array_position(F.transform(left, lambda y: _alike(x, y)), True).cast("int")
        return F.filter(left, lambda _, i: i != at - 1)

    rest = F.aggregate(a, b, step)
    matched = F.size(b) - F.size(rest)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), matched / (F.size(a) + F.size(b) - matched)).otherwise(0.0)


def rule_stems(r: Column) -> Column:
    """What relationship compares of a rule (a struct of subject, outcome, statement, polarity, null_finding, conditions: text), made once for each."""
    every = stems(F.concat_ws(" ", r["subject"], r["outcome"], r["statement"]))
    own = {c: stems(r[c]) for c in ("subject", "outcome", "statement", "conditions")} | {"every": every, "negated": F.exists(every, negated)}
    return F.struct(*[v.alias(c) for c, v in own.items()], r["polarity"].alias("polarity"), r["null_finding"].alias("null_finding"), (F.length(r["conditions"]) == 0).alias("free"))


def relationship(a: Column, b: Column, shared_context: Column) -> Column:
    """How two rules, as rule_stems, relate to each other."""
    like = lambda x, y: fuzzy_jaccard(a[x], b[y])
    crossed = (like("subject", "outcome") >= SAME) & (like("outcome", "subject") >= SAME)
    opposed = F.array_sort(F.array(a["polarity"], b["polarity"])) == F.array(F.lit("negative"), F.lit("positive"))
    fits = a["free"] | b["free"] | (like("conditions", "conditions") >= CONDITION)
    tension = (a["negated"] != b["negated"]) & (like("every", "every") >= TENSION)

    def named(subject):
        same = (subject >= SAME) & (like("outcome", "outcome") >= SAME)
        return first_match(
            [
                ("contradictory", same & (opposed | (a["null_finding"] != b["null_finding"]))), ("equivalent", same & fits), ("overlapping", same),
                ("reverse_direction", crossed), ("scope_tension", tension),
                ("complementary", (subject >= SUBJECT) | (like("statement", "statement") >= STATEMENTS)), ("shared_context", shared_context),
            ],
            "unrelated",
        )

    return T.let(like("subject", "subject"), named)


# Words of rules that say too little to merge on; likeness of subjects, outcomes and statements for each reason and signal.
GENERIC = "content dream giấc mơ nội orient process quá relate trình".split()
EQUIVALENT, MEANINGFUL, SIDE, SIDE_STATEMENT, STATEMENT_ALONE, STATEMENT_SIDES, QUESTION = 0.65, 0.72, 0.15, 0.25, 0.55, 0.3, 0.45
RELATED, RELATED_RAW, SIMILAR_STATEMENT = 0.3, 0.45, 0.25


def merge_stems(r: Column) -> Column:
    """What merging compares of a rule (a struct of subject, outcome, statement, polarity, null_finding), made once for each."""
    bare = lambda x: F.array_except(x, F.array(*map(F.lit, GENERIC)))
    own = {c: stems(r[c]) for c in ("subject", "outcome", "statement")}
    return F.struct(
        *[v.alias(c) for c, v in own.items()], bare(own["subject"]).alias("bare_subject"), bare(own["outcome"]).alias("bare_outcome"), r["polarity"].alias("polarity"), r["null_finding"].alias("null_finding")
    )


def merge_assessment(a: Column, b: Column, same_paragraph: Column, same_question: Column, same_source: Column) -> Column:
    """struct<can_merge, reasons, signals> of two rules, as merge_stems: why they may become one, and what else they have in common."""
    like = {c: fuzzy_jaccard(a[c], b[c]) for c in ("subject", "outcome", "statement", "bare_subject", "bare_outcome")}

    def judged(n):
        opposed = F.array_sort(F.array(a["polarity"], b["polarity"])) == F.array(F.lit("negative"), F.lit("positive"))
        way = ~F.coalesce(opposed, F.lit(False)) & a["null_finding"].eqNullSafe(b["null_finding"])
        reasons = {
            "same_canonical_paragraph": same_paragraph,
            "equivalent_subject_and_outcome": (n["subject"] >= EQUIVALENT) & (n["outcome"] >= EQUIVALENT),
            "same_meaningful_subject": (n["bare_subject"] >= MEANINGFUL) & ((n["bare_outcome"] >= SIDE) | (n["statement"] >= SIDE_STATEMENT)),
            "same_meaningful_outcome": (n["bare_outcome"] >= MEANINGFUL) & ((n["bare_subject"] >= SIDE) | (n["statement"] >= SIDE_STATEMENT)),
            "same_statement_semantics": (n["statement"] >= STATEMENT_ALONE) & (n["bare_subject"] >= STATEMENT_SIDES) & (n["bare_outcome"] >= STATEMENT_SIDES),
            "same_question_and_semantics": same_question & (n["statement"] >= QUESTION),
        }
        signals = {
            "same_source_document": same_source, "same_canonical_paragraph": same_paragraph, "related_subject": (n["bare_subject"] >= RELATED) | (n["subject"] >= RELATED_RAW),
            "related_outcome": (n["bare_outcome"] >= RELATED) | (n["outcome"] >= RELATED_RAW), "similar_statement": n["statement"] >= SIMILAR_STATEMENT, "same_question_kind": same_question,
        }
        named = lambda of, more: F.array_compact(F.array(*[F.when(more & v, F.lit(k)) for k, v in of.items()]))
        found = named(reasons, way)
        return F.struct((F.size(found) > 0).alias("can_merge"), found.alias("reasons"), named(signals, F.lit(True)).alias("signals"))

    return T.let(F.struct(*[v.alias(k) for k, v in like.items()]), judged)


def likeness_items(stems_: Column) -> Column:
    """Keys of stems that are equal wherever _alike may hold, numbered where they repeat: two sets share at least as many as they have stems alike."""
    keys = F.transform(stems_, lambda w: F.left(w, F.lit(5)))
    return T.let(keys, lambda ks: F.transform(ks, lambda k, i: F.concat_ws("#", k, F.size(F.filter(F.slice(ks, 1, i + 1), lambda o: o == k)).cast("string"))))
