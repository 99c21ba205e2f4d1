"""Classification against a controlled taxonomy, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The taxonomy, its signals, and what is no news.
CATEGORIES = ["GLOBAL_POLITICS", "WORLD_EVENTS", "WAR_CONFLICT", "ARTIFICIAL_INTELLIGENCE", "TECHNOLOGY", "SCIENCE", "HEALTH", "MEDICAL", "FINANCE", "BUSINESS", "INVESTMENTS", "CLIMATE_ENVIRONMENT", "SPORTS"]
ALLOWED = [c for c in CATEGORIES if c != "SPORTS"]
PRIORITY = ["WAR_CONFLICT", "ARTIFICIAL_INTELLIGENCE", "FINANCE", "INVESTMENTS", "BUSINESS", "MEDICAL", "HEALTH", "TECHNOLOGY", "SCIENCE", "CLIMATE_ENVIRONMENT", "SPORTS", "GLOBAL_POLITICS", "WORLD_EVENTS"]
REJECTED = ["CELEBRITY", "ENTERTAINMENT", "GAMING", "WEATHER", "LOCAL_LIFESTYLE", "TV_SCHEDULES", "LIFESTYLE", "HOLLYWOOD", "GAMING_NEWS", "SPORTS_NEWS", "QUIZ", "HOROSCOPE", "RECIPE", "COUPON", "SHOPPING", "DEALS", "OPINION", "EDITORIAL", "OBITUARY", "WELLNESS", "FITNESS", "DIET", "PODCAST", "NEWSLETTER"]
SIGNALS = {
    "WAR_CONFLICT": r"\bwar\b|\barmed conflict\b|\bceasefire\b|\bpeace talks\b|\bmilitary (?:operation|offensive|escalation|strike|forces?)\b|\bbattlefield\b|\binvasion\b|\bairstrike\b|\bmissile strike\b|\bfront line\b|\bhostilities\b|\bconflict zone\b",
    "ARTIFICIAL_INTELLIGENCE": r"\bartificial intelligence\b|\bgenerative ai\b|\bmachine learning\b|\bai\b|\bllm\b|\blarge language model\b|\bai agents?\b|\bopenai\b|\banthropic\b|\bchatgpt\b|\bai safety\b|\bai regulation\b|\bai model\b",
    "TECHNOLOGY": r"\bsemiconductor|\b(?:new )?chip\b|\bcloud infrastructure\b|\bcybersecurity\b|\bsoftware\b|\bhardware\b|\btelecom|\bdata cent(?:er|re)\b|\bconsumer technolog|\bransomware\b|\bsmartphone\b|\btechnology company\b|\btech company\b|\b(?:apple|google|microsoft|meta|nvidia|samsung|intel|qualcomm)\b.{0,60}\b(?:announc\w*|launch\w*|releas\w*|chip|cloud|data center|device|software|acquir\w*)",
    "GLOBAL_POLITICS": r"\belection\b|\bgovernment\b|\bparliament\b|\blegislation\b|\bdiplomac|\bdiplomatic\b|\binternational relations\b|\bforeign policy\b|\bsanctions\b|\bminister\b|\bpresident\b|\bcongress\b|\bwhite house\b|\bregulation\b|\bsecurity council\b|\bunited nations\b|\bnato\b",
    "FINANCE": r"\binterest rates?\b|\bcentral bank\b|\bfederal reserve\b|\binflation\b|\bfinancial markets?\b|\bstock market\b|\bbond markets?\b|\bcurrenc(?:y|ies)\b|\bcommodit(?:y|ies)\b|\bbanking sector\b|\bmarket (?:rally|selloff|surge|plunge)\b|\boil (?:prices?|market)\b|\bgold prices?\b|\beconomic indicator\b|\bgdp\b",
    "INVESTMENTS": r"\bmajor investment\b|\bventure capital\b|\bprivate equity\b|\bfunding round\b|\bcapital raise\b|\bsovereign (?:wealth )?fund\b|\binfrastructure investment\b|\b(?:energy|semiconductor|ai) investment\b|\binvestment of\b",
    "BUSINESS": r"\bmerger\b|\bacquisition\b|\bearnings\b|\bbankruptcy\b|\blayoffs?\b|\bcorporate restructuring\b|\bceo\b|\bcompany (?:announced|expands?|acquired|filed)\b|\bbusiness deal\b",
    "MEDICAL": r"\bclinical trial\b|\bvaccine\b|\bdrug approval\b|\bfda approval\b|\bdisease outbreak\b|\bcancer research\b|\bmedical (?:discovery|device|breakthrough|research)\b|\bhospital system\b|\bhospital (?:opens?|expands?|closes?|announces?)\b|\bpatient results\b",
    "HEALTH": r"\bpublic health\b|\bhealth system\b|\bhealthcare policy\b|\bhealth ministry\b|\bhealth emergency\b",
    "SCIENCE": r"\bscientific (?:discovery|finding|research)\b|\bresearch finding\b|\bspace (?:discovery|mission|telescope)\b|\bastronomy\b|\bphysics\b|\bgenetics?\b|\bquantum (?:research|discovery|science)\b|\bbiolog(?:y|ical)\b|\bscientists? (?:discover|find|report)\b",
    "CLIMATE_ENVIRONMENT": r"\bclimate (?:agreement|policy|research|change|summit)\b|\bemissions report\b|\brenewable energy\b|\bcarbon emissions\b|\benvironmental (?:event|regulation|policy)\b|\bwildfire\b|\bextreme (?:heat|weather|flooding)\b",
    "SPORTS": r"\bchampions league\b|\b(?:nba|nfl|fifa)\b|\bolympics?\b|\bformula 1\b|\bf1\b|\bcricket\b|\btennis\b|\bfootball\b|\bsoccer\b|\bchampionship\b|\btournament\b|\bmatch result\b|\btransfer\b",
    "WORLD_EVENTS": r"\binternational summit\b|\binternational organization\b|\binternational event\b|\bcross-border agreement\b|\bglobal treaty\b",
}
NOT_NEWS = r"\b(?:opinion|editorial|op-ed|interview|explainer|what you need to know|what to know|guide|listicle|horoscope|recipe|celebrity|lifestyle|podcast|gaming|wikipedia|list of|most \w+|all.time|records? and stats|standings|history of|year in review|tournaments?\s*:\s*results?|best .{0,30} to buy|products? to buy|review roundup)\b"
DEVELOPMENT = r"\b(?:announc\w*|approv\w*|launch\w*|releas\w*|decid\w*|discover\w*|find\w*|(?:reports? (?:finds?|says|shows|results?|released|issued)|report released)|ruled|ruling|acquir\w*|merg\w*|filed|bankrupt\w*|layoff\w*|earnings|expan\w*|invest\w*|rais\w*|fund\w*|sign\w*|ceasefire|escalat\w*|outbreak|breach\w*|cyberattack|outage|result|market move|market rally|market surge|market plunge|market fall|market gain|rose|rises|fell|falls|surged|plunged|climbed|dropped|hit record|reached record|killed|defeats?|sets? record|votes? to|passes?|win\w*.{0,80}\b(?:final|championship|tournament|title|cup|medal|record|first time)\b)\b"
# Other names of the categories, in the order in which partial matches are tried.
SYNONYMS = {
    "war": "WAR_CONFLICT", "conflict": "WAR_CONFLICT", "armed conflict": "WAR_CONFLICT", "military conflict": "WAR_CONFLICT", "war conflict": "WAR_CONFLICT", "ceasefire": "WAR_CONFLICT", "peace talks": "WAR_CONFLICT", "ukraine war": "WAR_CONFLICT", "israel gaza": "WAR_CONFLICT", "iran war": "WAR_CONFLICT", "sudan conflict": "WAR_CONFLICT", "middle east conflict": "WAR_CONFLICT", "military escalation": "WAR_CONFLICT",
    "politics": "GLOBAL_POLITICS", "global politics": "GLOBAL_POLITICS", "us politics": "GLOBAL_POLITICS", "government": "GLOBAL_POLITICS", "geopolitics": "GLOBAL_POLITICS", "international politics": "GLOBAL_POLITICS", "foreign policy": "GLOBAL_POLITICS", "diplomacy": "GLOBAL_POLITICS", "policy": "GLOBAL_POLITICS", "election": "GLOBAL_POLITICS", "sanctions": "GLOBAL_POLITICS", "government policy": "GLOBAL_POLITICS",
    "world affairs": "WORLD_EVENTS", "world news": "WORLD_EVENTS", "world events": "WORLD_EVENTS", "international news": "WORLD_EVENTS", "global news": "WORLD_EVENTS", "breaking news": "WORLD_EVENTS",
    "ai": "ARTIFICIAL_INTELLIGENCE", "artificial intelligence": "ARTIFICIAL_INTELLIGENCE", "artificial-intelligence": "ARTIFICIAL_INTELLIGENCE", "ai news": "ARTIFICIAL_INTELLIGENCE", "machine learning": "ARTIFICIAL_INTELLIGENCE", "llm": "ARTIFICIAL_INTELLIGENCE", "generative ai": "ARTIFICIAL_INTELLIGENCE", "ai model": "ARTIFICIAL_INTELLIGENCE", "ai regulation": "ARTIFICIAL_INTELLIGENCE", "ai research": "ARTIFICIAL_INTELLIGENCE",
    "tech": "TECHNOLOGY", "technology": "TECHNOLOGY", "software": "TECHNOLOGY", "hardware": "TECHNOLOGY", "cybersecurity": "TECHNOLOGY", "gadgets": "TECHNOLOGY", "semiconductor": "TECHNOLOGY", "chip": "TECHNOLOGY", "cloud": "TECHNOLOGY", "data center": "TECHNOLOGY", "telecom": "TECHNOLOGY", "internet infrastructure": "TECHNOLOGY",
    "finance": "FINANCE", "economy": "FINANCE", "markets": "FINANCE", "financial markets": "FINANCE", "banking": "FINANCE", "investing": "FINANCE", "stocks": "FINANCE", "interest rates": "FINANCE", "inflation": "FINANCE", "central bank": "FINANCE", "federal reserve": "FINANCE",
    "business": "BUSINESS", "companies": "BUSINESS", "corporate news": "BUSINESS", "startups": "BUSINESS", "commerce": "BUSINESS", "industry": "BUSINESS", "merger": "BUSINESS", "acquisition": "BUSINESS", "earnings": "BUSINESS", "layoffs": "BUSINESS", "bankruptcy": "BUSINESS",
    "investment": "INVESTMENTS", "investments": "INVESTMENTS", "venture capital": "INVESTMENTS", "private equity": "INVESTMENTS", "capital raise": "INVESTMENTS", "major investment": "INVESTMENTS", "funding round": "INVESTMENTS",
    "health": "HEALTH", "medicine": "HEALTH", "healthcare": "HEALTH", "medical news": "HEALTH", "public health": "HEALTH", "wellness": "HEALTH", "disease": "MEDICAL", "medical": "MEDICAL", "clinical trial": "MEDICAL", "hospital": "MEDICAL", "vaccine": "MEDICAL", "drug": "MEDICAL", "fda": "MEDICAL", "who": "MEDICAL", "cancer": "MEDICAL", "health research": "HEALTH",
    "science": "SCIENCE", "scientific research": "SCIENCE", "space": "SCIENCE", "astronomy": "SCIENCE", "physics": "SCIENCE", "biology": "SCIENCE", "quantum": "SCIENCE", "genetics": "SCIENCE", "research": "SCIENCE", "breakthrough": "SCIENCE",
    "climate": "CLIMATE_ENVIRONMENT", "environment": "CLIMATE_ENVIRONMENT", "climate change": "CLIMATE_ENVIRONMENT", "global warming": "CLIMATE_ENVIRONMENT", "clean energy": "CLIMATE_ENVIRONMENT", "extreme weather": "CLIMATE_ENVIRONMENT", "emissions": "CLIMATE_ENVIRONMENT", "renewable energy": "CLIMATE_ENVIRONMENT", "carbon": "CLIMATE_ENVIRONMENT",
    "sports": "SPORTS", "soccer": "SPORTS", "football": "SPORTS", "nba": "SPORTS", "nfl": "SPORTS", "tennis": "SPORTS", "cricket": "SPORTS", "olympics": "SPORTS", "f1": "SPORTS", "formula 1": "SPORTS", "transfer": "SPORTS", "injury update": "SPORTS", "championship": "SPORTS", "tournament": "SPORTS",
}
STATUS_ALIASES = {"approved": "recovery_required", "blocked": "failed", "dry_run": "draft", "skipped_dry_run": "draft", "unknown": "recovery_required"}
STATUSES = ["draft", "publishing", "published", "failed", "recovery_required"]
OPINION = r"\b(?:opinion|editorial|op-ed|interview|explainer|what to know|guide)\b"
PROMOTION = r"\b(?:sponsored|promotional|promo code|buy now|shopping deals)\b"


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _at_words(pattern: str) -> str:
    """The same pattern with a word boundary that all alternatives begin with in front of them, so that only words are tried."""
    parts, depth, start = [], 0, 0
    if "[" in pattern or "\\(" in pattern or "\\)" in pattern or "\\|" in pattern:
        return pattern
    for i, c in enumerate(pattern):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
    parts.append(pattern[start:])
    return rf"\b(?:{'|'.join(p[2:] for p in parts)})" if all(p.startswith(r"\b") for p in parts) else pattern


def infer_categories(text: Column, signals: dict[str, str] | None = None, among: Column | None = None) -> Column:
    """Sorted categories of which a signal occurs in the lower-case text; one regular expression for each, only those of ``among`` if given."""
    lowered = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")

    def hit(low: Column, c: str, p: str) -> Column:
        return F.when((F.array_contains(among, c) if among is not None else F.lit(True)) & low.rlike(_at_words(p)), c)

    # Named once: the patterns would each lower the whole text again.
    return let(lowered, lambda low: F.array_compact(F.array(*[hit(low, c, p) for c, p in sorted((signals or SIGNALS).items())])))


def primary_category(title: Column, body: Column, signals: dict[str, str] | None = None, priority: list[str] | None = None, among: Column | None = None) -> Column:
    """First category in order of priority from the title, else from the body; ``among``: those that can occur."""
    found = let(infer_categories(title, signals, among), lambda of_title: F.when(F.size(of_title) > 0, of_title).otherwise(infer_categories(body, signals, among)))
    return F.get(F.array_intersect(_list(priority or PRIORITY), found), F.lit(0))


def is_newsworthy(title: Column, body: Column) -> Column:
    return ~F.lower(title).rlike(NOT_NEWS) & F.lower(F.concat_ws(" ", title, body)).rlike(DEVELOPMENT)


def classify(title: Column, body: Column, signals: dict[str, str] | None = None, priority: list[str] | None = None) -> Column:
    """Struct of categories, primary_category, topic_fit, newsworthiness and article_quality.

    Each mention of it is computed anew: select it once and then its fields.
    """

    def of(categories: Column) -> Column:
        # Our own signals are words, so what the title or the body has, both together have; others may be bound to an end.
        primary = primary_category(title, body, signals, priority, categories if signals is None else None)
        return F.struct(
            categories.alias("categories"),
            F.coalesce(primary, F.get(categories, F.lit(0))).alias("primary_category"),
            (F.size(categories) > 0).alias("topic_fit"),
            is_newsworthy(title, body).alias("newsworthiness"),
            F.when(F.length(F.trim(body)) >= 500, "article").otherwise("snippet").alias("article_quality"),
        )

    return let(infer_categories(F.concat_ws(" ", title, body), signals), of)


def category_key(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(raw)), "[ -]", "_")


def is_rejected_category(raw: Column) -> Column:
    return F.coalesce(category_key(raw).isin(REJECTED), F.lit(False))


def normalize_category(raw: Column, synonyms: dict[str, str] | None = None, partial: bool = False) -> Column:
    """Rejected names first, then exact names, then synonyms; with ``partial`` the first synonym that holds or is held."""
    plain = F.replace(F.lower(F.trim(raw)), F.lit("_"), F.lit(" "))
    out = F.when(is_rejected_category(raw) | (plain == ""), None).when(category_key(raw).isin(CATEGORIES), category_key(raw))
    for key, value in (synonyms or {}).items():
        out = out.when(plain == key, value)
    for key, value in (synonyms or {}).items() if partial else ():
        out = out.when(plain.contains(key) | F.lit(key).contains(plain), value)
    return out


def synonym(raw: Column, partial: bool = False) -> Column:
    """One category name against the whole synonym table, as a map look-up and, if asked for, the first partial match."""
    plain = F.replace(F.lower(F.trim(raw)), F.lit("_"), F.lit(" "))
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    names = _list(SYNONYMS)
    found = F.element_at(known, plain)
    if partial:
        near = F.get(F.filter(names, lambda k: plain.contains(k) | k.contains(plain)), F.lit(0))
        found = F.coalesce(found, F.element_at(known, near))
    rejected = is_rejected_category(raw) | F.coalesce(plain.isin([r.lower().replace("_", " ") for r in REJECTED]), F.lit(False))
    return F.when(rejected | (plain == ""), None).when(category_key(raw).isin(CATEGORIES), category_key(raw)).otherwise(found)


def normalize_categories(raw: Column, partial: bool = True) -> Column:
    """Sorted distinct categories of a list of names; unknown and rejected ones go."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(raw, lambda c: synonym(c, partial)))))


def allowed_only(categories: Column) -> Column:
    """The categories that may be published, in their order."""
    return F.array_intersect(categories, _list(ALLOWED))


def categories_at_read(own: Column, metadata: Column) -> Column:
    """An item's categories, else those in its metadata (JSON): a list, or one name as a list of one."""
    listed = F.from_json(F.get_json_object(metadata, "$.categories"), "array<string>")
    single = F.get_json_object(metadata, "$.categories")
    kept = F.when(F.size(listed) > 0, listed).when(single.isNotNull() & ~single.startswith("["), F.array(single))
    return F.when(F.size(own) > 0, own).otherwise(F.coalesce(kept, F.array().cast("array<string>")))


def assessed(topic_fit: Column, newsworthiness: Column, title: Column, summary: Column, signals: dict[str, str] | None = None) -> Column:
    """Stored flags where both are there, else those of the classification of title and summary."""
    fits = F.size(infer_categories(F.concat_ws(" ", title, summary), signals)) > 0
    known = topic_fit.isNotNull() & newsworthiness.isNotNull()
    return F.when(known, F.struct(topic_fit.alias("topic_fit"), newsworthiness.alias("newsworthiness"))).otherwise(F.struct(fits.alias("topic_fit"), is_newsworthy(title, summary).alias("newsworthiness")))


def publication_status(raw: Column) -> Column:
    """Canonical status of a publication; null if it is none."""
    low = F.lower(F.trim(raw))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_ALIASES.items() for x in pair]), low), low)
    return F.when(named.isin(STATUSES), named)
