"""Classifiers of events, urls, commits and diffs as ordered rules over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules below must give the categories that existing logs carry.
URL_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("research", ("arxiv.org", "pubmed", "pmc.ncbi", "jov.arvojournals", "biorxiv.org", "semanticscholar", "springer.com/article", "elifesciences.org", "researchgate.net/publication", "dspace.mit.edu", "cvrl.org", "ncbi.nlm.nih.gov/books", "sciencedirect.com")),
    ("docs", ("github.com", "docs.", "developer.", "mdn.", "readthedocs", "deepwiki.com")),
    ("blog", ("medium.com", "dev.to", "substack.com", ".blog", "wordpress", "humanlayer.dev/blog", "gend.co/blog", "promptlayer.com", "eesel.ai/blog", "smartscope.blog", "boxesandarrows.com")),
    ("news", ("news.", "sciencedaily", "arstechnica", "theverge", "wired.com", "techcrunch", "hackernews", "news.ycombinator")),
    ("reference", ("wikipedia.org", "stackoverflow.com", "stackexchange.com")),
)
CONVENTIONAL = {"feat": "feature", "fix": "fix", "bugfix": "fix", "refactor": "refactor", "docs": "docs", "test": "test", "tests": "test", "chore": "chore", "ci": "ci", "style": "style", "perf": "perf", "build": "build", "revert": "revert"}
SCOPED = ("feat", "fix", "refactor", "docs", "test", "chore", "ci", "style", "perf", "build", "revert")
KEYWORDS = (("feature", "[Aa]dd|[Ii]mplement|[Cc]reate"), ("fix", "[Ff]ix|[Rr]esolve|[Pp]atch"), ("refactor", "[Rr]efactor|[Cc]lean|[Ss]implif"), ("enhancement", "[Uu]pdate|[Ee]nhance|[Ii]mprov"))
COMMIT_SALIENCE = {"feature": 0.7, "fix": 0.7, "refactor": 0.6, "revert": 0.6, "perf": 0.6, "enhancement": 0.5, "other": 0.5, "docs": 0.4, "test": 0.4, "chore": 0.4, "ci": 0.4, "build": 0.4, "style": 0.3}
URL_SALIENCE = {"research": 0.7, "docs": 0.5, "reference": 0.5}
TYPE_SALIENCE = {"search": 0.5, "search_result": 0.3, "tool_file_edit": 0.4, "tool_bash": 0.2, "git_push": 0.6, "knowledge_gap": 0.6}
NOISE_TYPES = ("bridge_ping_received", "bridge_ping_sent")
NOISE_MILESTONES = ("agent_Explore", "agent_Plan", "agent_general-purpose")
AGENTS = ("Explore", "Plan", "general-purpose")
NOISY_PATHS = r"/node_modules/|/\.git/|/package-lock\.json$|/yarn\.lock$|/pnpm-lock\.yaml$"
NOISY_COMMANDS = r"^(ls|cat |echo |pwd$|cd |which |wc |head |tail )"
NOISE_CLASSES = (
    ("task-notification", "<task-notification>", False),
    ("slash-command", "<command-name>", False),
    ("command-caveat", "<local-command-caveat>", False),
    ("command-output", "<local-command-stdout>", False),
    ("command-output", "<local-command-stderr>", False),
    ("skill-injection", "Base directory for this skill:", True),
    ("skill-launch", "Launching skill:", True),
    ("compaction-summary", "This session is being continued", True),
)


def first_match(pairs: Sequence[tuple[Column, Column | str | float]], default: Column) -> Column:
    """Value of the first condition that holds."""
    out = default
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def url_category(url: Column, rules=URL_RULES) -> Column:
    low = F.lower(url)
    hit = lambda needles: F.coalesce(sum((low.contains(n).cast("int") for n in needles), F.lit(0)) > 0, F.lit(False))
    return first_match([(hit(needles), F.lit(name)) for name, needles in rules], F.lit("other"))


def commit_type(subject: Column, dialect: str = "hook") -> Column:
    """`hook`: conventional prefix, else keywords, else other.  `strict`: one of eleven prefixes, else null."""
    if dialect == "strict":
        return F.nullif(F.regexp_extract(subject, "^(" + "|".join(SCOPED) + r")(\(.*\))?[!]?:", 1), F.lit(""))
    prefixes = [(subject.startswith(p + ":") | (subject.startswith(p + "(") if p in SCOPED else F.lit(False)), F.lit(v)) for p, v in CONVENTIONAL.items()]
    return first_match([*prefixes, *[(subject.rlike(k), F.lit(v)) for v, k in KEYWORDS]], F.lit("other"))


def commit_salience(kind: Column, files: Column, subject: Column) -> Column:
    """Weight of a commit: by type, a tenth more each for over five files and for a release, at most 1."""
    base = first_match([(kind == k, F.lit(v)) for k, v in COMMIT_SALIENCE.items()], F.lit(0.5))
    wide = F.when(files > 5, 0.1).otherwise(0.0)
    release = F.when(subject.rlike(r"^[Rr]elease |v[0-9].*\.[0-9]"), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), base + wide + release), 2)


def salience(kind: Column, category: Column | None = None, milestone: Column | None = None) -> Column:
    """Weight of an event other than a commit, from its type, url category or milestone."""
    rules = []
    if milestone is not None:
        rules += [(milestone == "session_wrapup", F.lit(0.9)), (milestone.startswith("session_end_"), F.lit(0.5)), (milestone.startswith("compaction_") | milestone.startswith("agent_"), F.lit(0.4))]
    rules += [(kind == t, F.lit(v)) for t, v in TYPE_SALIENCE.items()]
    if category is not None:
        rules += [(category == c, F.lit(v)) for c, v in URL_SALIENCE.items()] + [(category.isNotNull(), F.lit(0.4))]
    return first_match(rules, F.lit(0.5))


def clamp_salience(value: Column) -> Column:
    """Null and 0 become 0.5, the rest stays within 0.05 and 1."""
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, 0.5).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), value)))


def diff_quadrant(files_new: Column, added: Column, removed: Column) -> Column:
    fresh = F.when(added < 100, "bootstrap").otherwise("construct")
    old = F.when(added + removed < 50, "surgical").otherwise("rework")
    return F.when(files_new > 0, fresh).otherwise(old)


def diff_shape(changes: DataFrame, *keys: str) -> DataFrame:
    """Shape of each commit from its file changes (status A/M/D, added, removed)."""
    status = lambda s: F.count_if(F.col("status") == s).alias
    shape = changes.groupBy(*keys).agg(status("A")("files_new"), status("M")("files_modified"), status("D")("files_deleted"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"))
    return shape.withColumn("quadrant", diff_quadrant(F.col("files_new"), F.col("lines_added"), F.col("lines_removed")))


def is_high_signal(kind: Column, milestone: Column) -> Column:
    kind, milestone = F.coalesce(kind, F.lit("")), F.coalesce(milestone, F.lit(""))
    noise = kind.isin(*NOISE_TYPES) | milestone.isin(*NOISE_TYPES, *NOISE_MILESTONES) | kind.startswith("milestone_agent_")
    return ~(noise | kind.startswith("bridge_ping") | milestone.startswith("bridge_ping"))


def high_signal(events: DataFrame) -> DataFrame:
    milestone = F.col("milestone") if "milestone" in events.columns else F.lit("")
    return events.where(is_high_signal(F.col("type"), milestone))


def event_category(kind: Column, source: Column) -> Column:
    """Display label of an event's type, else its source."""
    k = F.coalesce(kind, F.lit(""))
    rules = [
        (k.isin("fetch", "research_fetch"), "fetch"), (k.isin("search", "research_search"), "search"), (k == "search_result", "result"),
        (k.contains("compaction"), "compaction"), (k.contains("session_end"), "session end"), (k.contains("bridge_query"), "bridge query"),
        (k == "tool_file_edit", "edit"), (k == "tool_bash", "bash"), (k == "git_commit", "commit"), (k == "git_push", "push"), (k.startswith("memory_"), "memory"),
    ]
    rest = F.coalesce(F.nullif(source, F.lit("")), F.nullif(k, F.lit("")), F.lit("?"))
    return first_match([(c, F.lit(v)) for c, v in rules], rest)


def tool_events(raw: DataFrame) -> DataFrame:
    """Raw tool calls (tool, file_path, command, response, ...) to events; noisy paths and commands go.

    Adds type, summary, commit_hash, commit_type and salience.
    """
    command, path = F.substring("command", 1, 500), F.col("file_path")
    edit = F.col("tool").isin("Edit", "Write") & (F.coalesce(path, F.lit("")) != "") & ~path.rlike(NOISY_PATHS)
    bash = (F.col("tool") == "Bash") & (F.coalesce(command, F.lit("")) != "") & ~command.rlike(NOISY_COMMANDS)
    response = F.substring(F.coalesce("response", F.lit("")), 1, 2000)
    commit_hash = F.nullif(F.regexp_extract(response, "([a-f0-9]{7,})", 1), F.lit(""))
    message = F.regexp_extract(response, r"\] (.+)", 1)
    asked = command.contains("git commit")
    committed = bash & asked & commit_hash.isNotNull()
    pushed = bash & ~asked & command.contains("git push")
    own = raw.where(F.coalesce(edit | bash, F.lit(False)))
    kind = F.when(edit, "tool_file_edit").when(committed, "git_commit").when(pushed, "git_push").otherwise("tool_bash")
    ctype = F.when(committed, commit_type(message))
    summary = (
        F.when(edit, F.concat(F.lit("Modified: "), path))
        .when(committed, F.concat(F.lit("["), ctype, F.lit("] Commit "), commit_hash, F.lit(": "), message))
        .when(pushed, F.concat(F.lit("Pushed: "), command))
        .when(asked, F.concat(F.lit("Ran: "), command))
        .otherwise(F.concat(F.lit("Ran: "), F.substring(command, 1, 200)))
    )
    out = own.withColumns({"type": kind, "summary": summary, "commit_hash": F.when(committed, commit_hash), "commit_type": ctype})
    weight = F.when(F.col("type") == "git_commit", commit_salience(F.col("commit_type"), F.lit(0), message)).otherwise(salience(F.col("type")))
    return out.withColumn("salience", weight)


def milestone_events(raw: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Lifecycle rows (event, trigger, reason, agent_type) to milestones with description and salience; other rows go.

    With the unified `log`, rows (session_id, git_branch, git_dirty_files) also get
    session_event_count, the log's lines of their session (0 without one), and
    rich_summary, the description with branch, changed files and that count.
    """
    event, trigger, reason, agent = F.col("event"), F.coalesce("trigger", F.lit("unknown")), F.coalesce("reason", F.lit("unknown")), F.coalesce("agent_type", F.lit("unknown"))
    milestone = F.when(event == "PreCompact", F.concat(F.lit("compaction_"), trigger)).when(event == "SessionEnd", F.concat(F.lit("session_end_"), reason)).when((event == "SubagentStop") & agent.isin(*AGENTS), F.concat(F.lit("agent_"), agent))
    text = (
        F.when(event == "PreCompact", F.concat(F.lit("Context compaction ("), trigger, F.lit(") — session at peak density")))
        .when(event == "SessionEnd", F.concat(F.lit("Session ended ("), reason, F.lit(")")))
        .otherwise(F.concat(agent, F.lit(" agent completed")))
    )
    out = raw.withColumn("milestone", milestone).withColumn("description", text).where(F.col("milestone").isNotNull())
    out = out.withColumn("salience", salience(F.concat(F.lit("milestone_"), F.col("milestone")), milestone=F.col("milestone")))
    return out if log is None else with_rich_summary(out, log)


def with_rich_summary(milestones: DataFrame, log: DataFrame) -> DataFrame:
    counts = log.where(F.coalesce("session_id", F.lit("")) != "").groupBy("session_id").agg(F.count(F.lit(1)).alias("session_event_count"))
    out = milestones.join(counts, "session_id", "left").withColumn("session_event_count", F.coalesce("session_event_count", F.lit(0)))
    branch, dirty = F.coalesce("git_branch", F.lit("")), F.coalesce("git_dirty_files", F.lit(0)).cast("string")
    state = F.when(branch != "", F.concat(branch, F.lit(", "), dirty, F.lit(" dirty, "))).otherwise("")
    return out.withColumn("rich_summary", F.concat("description", F.lit(" ["), state, F.col("session_event_count").cast("string"), F.lit(" events]")))


def noise_class(text: Column) -> Column:
    """Kind of machine-made message, null for others."""
    rules = [((text.startswith(mark) if start else text.contains(mark)), F.lit(name)) for name, mark, start in NOISE_CLASSES]
    return first_match(rules, F.lit(None).cast("string"))


def noise_summary(text: Column, kind: Column) -> Column:
    """Short label of a machine-made message."""
    tag = lambda name: F.regexp_extract(text, f"<{name}>([^<]+)", 1)
    detail = F.when(tag("summary") != "", F.concat(F.lit(": "), F.substring(tag("summary"), 1, 80))).otherwise("")
    output = F.substring(F.trim(F.regexp_replace(text, "<[^>]+>", "")), 1, 80)
    skill = F.regexp_extract(text, r"^Base directory for this skill:[^\n]*\n+#\s*([^\n]+)", 1)
    return first_match(
        [
            (kind == "task-notification", F.concat(F.lit("agent "), tag("status"), detail)),
            (kind == "slash-command", tag("command-name")),
            (kind == "command-caveat", F.lit("local command output follows")),
            (kind == "command-output", F.when(output == "", "command output").otherwise(output)),
            (kind == "skill-injection", F.concat(F.lit("skill loaded: "), F.when(skill == "", "skill").otherwise(skill))),
            (kind == "skill-launch", F.concat(F.lit("launching "), F.regexp_extract(text, r"^Launching skill:\s*([^\n]+)", 1))),
            (kind == "compaction-summary", F.lit("session continuation summary")),
        ],
        F.lit(None).cast("string"),
    )


CLASSIFIERS: dict = {}


def register_classifier(name: str, fn) -> None:
    """Make a DataFrame -> DataFrame enrichment known under a name."""
    CLASSIFIERS[name] = fn


def apply_classifier(events: DataFrame, name: str) -> DataFrame:
    return CLASSIFIERS[name](events)
