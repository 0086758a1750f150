"""Synthetic labelled corpus (S13), generated *by Spark from a driving
table*: every row of the driver (e.g. documents) becomes one generated text,
so the work grows with the data.  Choices come from ``hash_key`` so the
output is identical on any cluster size.

Category = (rank of the row in hash order) mod 6 -> classes are balanced to
+-1; only 6 * (n // 6) rows are kept, as in the original generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..functions.labels import SYNTH_LABELS
from ..operators.sampling import exact_rank

# The six categories and their ten template sentences each.
TEMPLATES = {
    "true": [
        "The Senate passed a new infrastructure bill with bipartisan support on Tuesday.",
        "According to official reports, unemployment rates fell to 3.5 percent this quarter.",
        "The Federal Reserve announced a 0.25 percent interest rate increase today.",
        "The president signed an executive order on climate policy during a ceremony at the White House.",
        "Voter turnout in the midterm elections reached 50 percent, according to election officials.",
        "The Supreme Court agreed to hear arguments on the immigration policy case next month.",
        "A bipartisan committee released its findings on government spending waste.",
        "Officials confirmed the trade agreement will take effect starting January 1.",
        "The Department of Education released new guidelines for student loan forgiveness.",
        "Congressional leaders from both parties agreed on a temporary spending measure.",
    ],
    "satire/parody": [
        "Area congressman reportedly shocked to learn his constituents actually read his tweets.",
        "Local politician promises to fix potholes by simply renaming them 'freedom craters'.",
        "Man who gets all his news from memes somehow perfectly informed about geopolitics.",
        "Senate votes unanimously to extend lunch break by 45 minutes in historic bipartisan move.",
        "Presidential candidate reveals bold plan to solve all problems by tweeting about them.",
        "Breaking: Congress discovers that laws work better when people actually follow them.",
        "Politician's fact-check rating so low it actually wraps around to being impressive.",
        "Study finds 90 percent of campaign promises were made with fingers crossed behind back.",
        "Town hall meeting descends into chaos when politician accidentally tells the truth.",
        "New bill would require all political ads to include laugh track.",
    ],
    "misleading content": [
        "EXPOSED: The hidden truth about government surveillance that they don't want you to know!",
        "This one weird trick is what politicians use to stay in power forever.",
        "Scientists CONFIRM what we've been saying all along about the economy.",
        "Exposed: The REAL reason behind the latest policy change will shock you.",
        "What the mainstream media won't tell you about the new healthcare law.",
        "EXPOSED: Secret meetings between officials reveal the TRUTH about spending.",
        "You won't believe what this leaked document says about the election.",
        "The government doesn't want you to know this about your tax dollars.",
        "BREAKING: whistleblower reveals the shocking truth behind the policy.",
        "This controversial study proves everything you thought about politics was WRONG.",
    ],
    "imposter content": [
        "Official White House statement: President declares national emergency over social media usage.",
        "AP Breaking News: Congress votes to abolish all federal holidays starting next year.",
        "Reuters Exclusive: Secret documents reveal plan to merge three government agencies.",
        "CDC Official Report: New study links political debates to increased stress hormones.",
        "FBI Press Release: Agency announces new division dedicated to monitoring meme accounts.",
        "Pentagon confirms development of weather control satellite for agricultural purposes.",
        "WHO declares political misinformation a global health emergency in surprise announcement.",
        "Official Treasury Department memo leaked revealing plans to redesign all currency.",
        "NASA Administrator statement: Agency to redirect funds from space to political education.",
        "FEMA announces new preparedness category for surviving election seasons.",
    ],
    "false connection": [
        "President caught in massive scandal (article about routine policy meeting).",
        "BREAKING: Government in crisis after shocking revelation (story about minor budget adjustment).",
        "Millions affected by new law (article about obscure regulatory change).",
        "Democracy under threat: dramatic headline for a routine committee hearing update.",
        "Economy on the brink of collapse says expert (article quotes one minor analyst).",
        "Outrage erupts over political decision (three people tweeted about it).",
        "Bombshell report rocks Washington (small footnote in a quarterly review).",
        "Historic moment as politician makes unprecedented move (routine procedural vote).",
        "Nation divided over controversial new policy (poll shows 52-48 split on minor issue).",
        "Crisis at the border reaches new heights (seasonal fluctuation in crossing numbers).",
    ],
    "manipulated content": [
        "The senator clearly stated support for abolishing all public schools in this speech.",
        "Doctored transcript shows the official admitting to corruption during the hearing.",
        "Edited video proves the politician made racist remarks at last night's rally.",
        "Altered quote from the governor shows plans to raise taxes by 500 percent.",
        "Manipulated photo shows the mayor at a controversial protest he never attended.",
        "Modified audio clip appears to show congressman accepting bribes from lobbyists.",
        "Cropped screenshot of politician's email taken completely out of context to suggest wrongdoing.",
        "Selectively edited interview makes it appear the candidate supports extremist views.",
        "Fake transcript of closed-door meeting circulated to undermine policy negotiations.",
        "Spliced together clips from different speeches to fabricate incriminating statement.",
    ],
}
SUFFIXES = ["Read more.", "Share this.", "Developing story.", ""]
PREFIXES = ["BREAKING: ", "UPDATE: ", "JUST IN: ", ""]
CATEGORIES = list(TEMPLATES)
SCHEME_MAPS = {
    "2way": {c: ("true" if c == "true" else "fake") for c in CATEGORIES},
    "3way": {c: (c if c in ("true", "satire/parody") else "fake") for c in CATEGORIES},
    "6way": {c: c for c in CATEGORIES},
}


def template_table(spark) -> DataFrame:
    rows = [(ci, ti, t) for ci, c in enumerate(CATEGORIES) for ti, t in enumerate(TEMPLATES[c])]
    return spark.createDataFrame(rows, "cat int, tpl int, template string")


def generate_corpus(driver: DataFrame, key: str = "doc_id", scheme: str = "6way", seed: int = 42) -> DataFrame:
    """One synthetic row per driver row (minus the n mod 6 remainder).
    Output: key, text, label, label_id, category."""
    spark = driver.sparkSession
    base = driver.select(key).withColumn("_all", F.lit(0))
    r = exact_rank(base, ["_all"], key, seed)
    keep = r.where(F.col("_rank") < F.floor(F.col("_n") / 6) * 6)
    g = (keep.withColumn("cat", F.pmod(F.col("_rank"), F.lit(6)).cast("int"))
             .withColumn("tpl", F.pmod(hash_key(seed, F.lit("tpl"), key), F.lit(10)).cast("int"))
             .withColumn("var", F.pmod(hash_key(seed, F.lit("var"), key), F.lit(3)).cast("int"))
             .withColumn("aff", F.pmod(hash_key(seed, F.lit("aff"), key), F.lit(4)).cast("int")))
    t = g.join(F.broadcast(template_table(spark)), ["cat", "tpl"])  # 60-row table
    suf = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), F.col("aff") + 1)
    pre = F.element_at(F.array(*[F.lit(s) for s in PREFIXES]), F.col("aff") + 1)
    text = (F.when(F.col("var") == 0, F.col("template"))
             .when(F.col("var") == 1, F.concat(F.col("template"), F.lit(" "), suf))
             .otherwise(F.concat(pre, F.col("template"))))
    cat_name = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("cat") + 1)
    m = SCHEME_MAPS[scheme]
    labels = SYNTH_LABELS[scheme]
    label = F.element_at(F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.lit(m[c]))]), cat_name)
    lid = F.array_position(F.array(*[F.lit(x) for x in labels]), label) - 1
    return t.select(key, text.alias("text"), label.alias("label"), lid.cast("int").alias("label_id"),
                    cat_name.alias("category"))
