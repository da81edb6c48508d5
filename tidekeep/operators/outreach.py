"""Own-language templates, prompt text, and the choice of what to serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import whole
from ..functions.text import contains_any
from ..lexicon import DEFAULT, Lexicon
from . import guardrails as gr
from .decide import ACTION_LABELS
from .listen import LOW, with_detected_language
from .literal import literal_table, lookup

LANGUAGE_NAMES = {"en": "English", "ar": "Arabic", "hi": "Hindi (romanized)", "tl": "Tagalog"}
LANGUAGE_UNKNOWN = "the language of the customer"
QUERY_ANSWER = "A colleague will send you the exact details soon."

TEMPLATES: dict[str, dict[str, str]] = {
    "dignified_goodbye": {
        "en": "Dear customer, thank you for all the time you spent with us. Moving is a lot of work, so "
              "let us take care of the bank side: closing accounts, sending your balance onward and "
              "issuing any letters you may need. We wish you the very best in your next home.",
        "ar": "عميلنا الكريم، شكرا على كل السنوات التي قضيتموها معنا. الانتقال متعب، لذلك دعونا نهتم "
              "بالجانب المصرفي: إقفال الحسابات وإرسال الرصيد وإصدار الخطابات المطلوبة. نتمنى لكم كل "
              "التوفيق في بيتكم الجديد.",
        "hi": "Priya grahak, itne saal humare saath rahe uske liye dhanyavaad. Ghar badalna aasaan nahi "
              "hai, isliye bank ka kaam hum karenge: khaata band karna, paise bhejne ka kaam aur zaroori "
              "kaagaz. Aapke naye ghar ke liye bahut shubhkaamnayein.",
        "tl": "Mahal na kliyente, salamat po sa lahat ng taon na kasama namin kayo. Mahirap ang paglipat, "
              "kaya kami na po ang bahala sa bangko: pagsara ng account, pagpapadala ng pera at mga sulat "
              "na kailangan. Nais namin ang mabuti sa bago ninyong tahanan.",
    },
    "fee_waiver": {
        "en": "Dear customer, your complaint is justified and we apologise. We looked into the charge "
              "and are taking AED {offer} off your account again. Should anything else look odd to you, "
              "just answer this note and one of us will look at it.",
        "ar": "عميلنا الكريم، شكواكم في محلها ونحن نعتذر. راجعنا المبلغ وسنعيد إلى حسابكم AED {offer} "
              "كاملة. إذا لاحظتم أي أمر آخر غير واضح فيكفي الرد على هذه الرسالة وسيتابعها أحد زملائنا معكم.",
        "hi": "Priya grahak, AED {offer} ka ye charge bank ki bhool thi, aapki nahi. Kal tak poora paisa "
              "aapke khaate mein dikhega. Batane ke liye dhanyavaad; hum apna tareeka badal rahe hain "
              "aur aap ke liye dhyan rakhenge.",
        "tl": "Mahal na kliyente, mali po ng bangko ang singil na AED {offer} at hindi ninyo dapat "
              "binayaran ito. Makikita ninyo ang buong halaga sa account sa loob ng ilang araw. Salamat sa "
              "pagsabi, at babantayan namin na hindi na ito mangyari.",
    },
    "remittance_support": {
        "en": "Dear customer, sending money home should be simple and fair. Your next transfer costs "
              "AED {offer} less, and a colleague who knows your route well is glad to show you the "
              "quickest way to send it.",
        "ar": "عميلنا الكريم، يجب أن يكون إرسال المال إلى الأهل سهلا وعادلا. سيكون تحويلكم القادم أقل "
              "بمقدار AED {offer} ويسعد أحد زملائنا الذين يعرفون وجهتكم جيدا أن يشرح لكم أسرع طريقة للإرسال.",
        "hi": "Priya grahak, ghar paise bhejne ka kaam aasaan hona chahiye. Aapka agla transfer AED {offer} "
              "sasta hai, aur jo saathi aapke desh ka rasta jaante hain vo aapko sabse tez tareeka "
              "dikha denge, aap ke liye.",
        "tl": "Mahal na kliyente, dapat madali at patas ang pagpapadala ng pera sa pamilya. Mas mababa ng "
              "AED {offer} ang susunod na padala ninyo, at may kasama kami na handang ituro ang mabilis "
              "na paraan para sa inyo.",
    },
    "loan_restructure_info": {
        "en": "Dear customer, a loan can weigh on anyone when plans change. One of our advisers will "
              "phone you, go through the figures with you and explain which options exist. Nothing "
              "changes unless you agree to it.",
        "ar": "عميلنا الكريم، قد يصبح القرض عبئا على أي شخص عندما تتغير الخطط. سيتصل بكم أحد مستشارينا "
              "ويراجع الأرقام معكم ويشرح الخيارات المتاحة. لن يتغير أي شيء دون موافقتكم.",
        "hi": "Priya grahak, plan badal jaaye to loan ka bojh bada lagta hai. Humare salahkaar aapko phone "
              "karke saare hisaab dekhenge aur vikalp samjha denge. Aapki haan ke bina kuch nahi badlega, "
              "ye hamesha yaad rahe.",
        "tl": "Mahal na kliyente, mabigat ang utang kapag nagbago ang plano. Tatawag po ang tagapayo namin "
              "para sa mga numero at sa mga paraan na maaari. Walang magbabago kung hindi kayo "
              "sang-ayon.",
    },
    "rm_call": {
        "en": "Dear customer, you matter to us and a note is not enough for this. Your relationship "
              "manager will ring you at a time that suits you, listen to what went wrong and settle "
              "it together with you.",
        "ar": "عميلنا الكريم، أنتم مهمون لنا ولا تكفي رسالة لهذا الموضوع. سيتصل بكم مدير علاقتكم في "
              "الوقت الذي يناسبكم ليستمع إليكم ويعرف ما حدث ويحل الأمر معكم.",
        "hi": "Priya grahak, aap humare liye khaas hain aur is baat ke liye sirf sandesh kaafi nahi hai. "
              "Aapke manager aapke samay par phone karenge, poori baat sunenge aur aapke saath hal "
              "nikaalenge.",
        "tl": "Mahal na kliyente, mahalaga po kayo sa amin at hindi sapat ang sulat para sa bagay na ito. "
              "Tatawag ang inyong manager sa oras na gusto ninyo, makikinig at aayusin ito kasama "
              "ninyo.",
    },
    "service_fix": {
        "en": "Dear customer, that should have worked and we are sorry that it did not. Your case is at "
              "the top of the list of the technical team, and a named colleague will report back to you "
              "once it is solved.",
        "ar": "عميلنا الكريم، كان ينبغي أن تعمل الخدمة ونأسف لأنها لم تعمل. وضعنا حالتكم في أعلى قائمة "
              "الفريق الفني وسيعود إليكم زميل محدد بالاسم بعد حل المشكلة.",
        "hi": "Priya grahak, ye seva chalni chahiye thi aur humein afsos hai ki nahi chali. Aapka maamla "
              "technical team ki list mein sabse upar hai, aur theek hone ke baad humare saathi aapke "
              "liye khabar bhejne ka kaam karenge.",
        "tl": "Mahal na kliyente, dapat gumana po ito at paumanhin na hindi. Nasa unahan ng listahan ng "
              "technical team ang kaso ninyo, at may kasama kami na babalik sa inyo kapag ayos na ang "
              "lahat.",
    },
    "proactive_checkin": {
        "en": "Dear customer, your last note made us want to ask how things are going. If there is "
              "something we can do better for you, write back in your own words; a real person reads "
              "every reply.",
        "ar": "عميلنا الكريم، بعد رسالتكم الأخيرة أردنا أن نسأل عن أحوالكم. إذا كان هناك ما يمكننا أن "
              "نقوم به بشكل أفضل فاكتبوا لنا بكلماتكم، فكل رد يقرأه شخص حقيقي.",
        "hi": "Priya grahak, aapke pichhle sandesh ke baad hum poochna chahte hain ki sab kaise hai. Agar "
              "hum kuch behtar kar sakte hain to apne shabdon mein likhiye; har jawab ek insaan padhta "
              "hai.",
        "tl": "Mahal na kliyente, dahil sa huling sulat ninyo ay gusto namin na kumustahin kayo. Kung may "
              "magagawa kami na mas mabuti, sumulat lang po sa sarili ninyong salita; tao ang bumabasa "
              "ng lahat ng sagot.",
    },
    "answer_query": {
        "en": "Dear customer, thank you for writing to us. {answer} If you would rather speak to "
              "somebody, call the branch or answer this note and we will call you.",
        "ar": "عميلنا الكريم، شكرا لكتابتكم إلينا. سيرسل لكم أحد زملائنا التفاصيل الدقيقة قريبا. إذا كنتم "
              "تفضلون الحديث مع شخص فاتصلوا بالفرع أو ردوا على هذه الرسالة وسنتصل بكم.",
        "hi": "Priya grahak, humein likhne ke liye dhanyavaad. Humare saathi aapko poori jaankari jaldi "
              "bhej denge. Agar aap baat karna chahte hain to branch ko phone karo ya isi sandesh ka jawab "
              "dijiye.",
        "tl": "Mahal na kliyente, nakarating po sa amin ang tanong ninyo. Isang kasama namin ang "
              "magbibigay ng buong sagot para sa inyo. Bukas din ang branch kung mas gusto ninyo na "
              "pumunta at makipag-usap sa isang tao.",
    },
    "human_triage": {
        "en": "[STAFF ONLY] No outreach was prepared: the labels were too uncertain, so a person "
              "has to read this case.",
    },
}

PROMPT_RULES = (
    "You write short, warm and honest notes for the customer care team of a bank (60 to 110 words).\n"
    "- Use only {language}.\n"
    "- No time pressure of any kind.\n"
    "- Name no offer, amount, rate or condition other than the one stated below.\n"
    "- For a goodbye: thank the customer, help with leaving, do not try to keep them.\n"
    "- Plain and respectful words.\n"
    "- No placeholders or brackets; open with a general greeting and close as the care team.")


def template_table(spark: SparkSession) -> DataFrame:
    """(action, lang, template): fixed, 33 rows."""
    return literal_table(spark, ["action", "lang", "template"], [
        (action, lang, text) for action, texts in TEMPLATES.items()
        for lang, text in texts.items()])


def fill(template: Column, offer: Column) -> Column:
    priced = F.replace(template, F.lit("{offer}"), whole(offer).cast("string"))
    return F.replace(priced, F.lit("{answer}"), F.lit(QUERY_ANSWER))


def with_template(plan: DataFrame) -> DataFrame:
    """Adds ``template_text`` and ``template_language``; English when the language has none."""
    table = template_table(plan.sparkSession)
    exact = F.broadcast(table.select(F.col("action").alias("_a"), F.col("lang").alias("_l"),
                                     F.col("template").alias("_exact")))
    english = F.broadcast(table.filter("lang = 'en'").select(
        F.col("action").alias("_ea"), F.col("template").alias("_english")))
    wanted = F.when(F.col("action") == "human_triage", "en").otherwise(F.col("language"))
    joined = (plan.join(exact, (F.col("action") == F.col("_a")) & (wanted == F.col("_l")), "left")
              .join(english, F.col("action") == F.col("_ea"), "left"))
    return joined.select(
        *plan.columns,
        fill(F.coalesce("_exact", "_english"), F.col("offer_value_aed")).alias("template_text"),
        F.coalesce("_l", F.lit("en")).alias("template_language"))


FACTS = ["candidate_language", "candidate_broken", "_written", "_urgent", "_slots", "_amounts",
         "_pressing", "_short", "_draft"]


def draft_facts(candidates: DataFrame, lex: Lexicon = DEFAULT, keep_text: bool = False) -> DataFrame:
    """What the checks need of each ``candidate`` text, found where the text is scanned.

    The facts are short whatever the length of the text. ``_draft`` is the text itself where it may
    still be served: a text that no plan can accept is not carried on.
    """
    kept, c = [k for k in candidates.columns if k != "candidate"], F.col
    # Renamed to the text columns of the listen stage, whose lower-casing is shared.
    renamed = candidates.select(*[F.col(k).alias(f"_p_{k}") for k in kept],
                                F.col("candidate").alias("text"),
                                F.lower("candidate").alias(LOW))
    detected = with_detected_language(renamed, lex, language="candidate_language",
                                      confidence="_candidate_confidence")
    lowered = detected.select(*[F.col(f"_p_{k}").alias(k) for k in kept],
                              F.col("text").alias("candidate"), "candidate_language",
                              F.col(LOW).alias("_clow"))
    looked_up = lowered.withColumns({
        "_urgent": gr.urgency_hits(c("_clow"), lex), "_slots": gr.placeholders(c("candidate")),
        "_found": gr.draft_amounts(c("_clow")), "_pressing": contains_any(c("_clow"), lex.pressure),
        "_short": gr.too_short(c("candidate")), "_written": c("candidate").isNotNull()})
    judged = looked_up.withColumns({
        # An amount token without digits makes the draft unusable before any flag is raised.
        "candidate_broken": F.exists("_found", lambda a: a.isNull()),
        "_amounts": F.array_distinct(F.array_compact("_found"))})
    hopeless = (c("candidate_broken") | (F.size("_urgent") > 0) | (F.size("_slots") > 0)
                | c("_short"))
    return judged.withColumn("_draft", F.when(~hopeless, c("candidate"))).select(
        *kept, *(["candidate"] if keep_text else []), *FACTS)


def raised_flags() -> Column:
    """All flags of a draft from its facts and the plan it is joined to."""
    c = F.col
    return gr.flags(c("_urgent"), c("_slots"),
                    gr.invented_amounts(c("_amounts"), c("offer_value_aed")),
                    (c("action") == "dignified_goodbye") & c("_pressing"), c("_short"),
                    c("language"), c("candidate_language"))


def check_candidates(drafts: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Adds ``candidate_language`` and ``candidate_flags`` for a ``candidate`` text column."""
    facts = draft_facts(drafts, lex, keep_text=True)
    return facts.select(
        *drafts.columns, "candidate_language", "candidate_broken",
        F.when(F.col("candidate_broken"), F.array().cast("array<string>"))
        .otherwise(raised_flags()).alias("candidate_flags"))


def serve(plan: DataFrame, lex: Lexicon = DEFAULT,
          candidates: DataFrame | None = None) -> DataFrame:
    """What the reviewer gets: the candidate draft if one exists and no check objects, else the
    template in the customer's language. Flags are kept either way.

    ``candidates`` (message_id, candidate) are checked at their scan and joined as facts; a plan
    that has a ``candidate`` column already is checked in place.
    """
    none = F.array().cast("array<string>")
    kept = plan.columns
    if candidates is not None:
        plan = plan.join(draft_facts(candidates, lex), "message_id", "left")
    elif "candidate" in kept:
        plan = draft_facts(plan, lex, keep_text=True)
    templated = with_template(plan)
    if "_draft" not in plan.columns:
        return templated.select(
            *kept, F.col("template_text").alias("draft_message"),
            F.col("template_language").alias("draft_language"),
            F.lit("template").alias("draft_source"), none.alias("guardrail_flags"))
    broken = F.coalesce("candidate_broken", F.lit(False))
    eligible = F.coalesce("_written", F.lit(False)) & (F.col("action") != "human_triage")
    checked = templated.withColumn("guardrail_flags", F.when(
        eligible & ~broken, raised_flags()).otherwise(none))
    chosen = checked.withColumn("_serve", eligible & ~broken & (F.size("guardrail_flags") == 0))
    return chosen.select(
        *kept,
        F.when(F.col("_serve"), F.col("_draft")).otherwise(F.col("template_text"))
        .alias("draft_message"),
        F.when(F.col("_serve"), F.col("language")).otherwise(F.col("template_language"))
        .alias("draft_language"),
        F.when(F.col("_serve"), "llm").otherwise("template").alias("draft_source"),
        "guardrail_flags")


def with_prompt(plan: DataFrame, tone: str | None = None) -> DataFrame:
    """Prompt text for an external generator; none for cases a person must read first."""
    label = lookup(F.col("action"), ACTION_LABELS)
    offer = F.col("offer_value_aed")
    offer_line = F.when(offer > 0, F.concat(
        F.lit("Offer to mention: AED "), whole(offer).cast("string"), F.lit(" ("), label,
        F.lit(")"))).otherwise(F.concat(F.lit("Action: "), label, F.lit(", without an offer")))
    # The rules stand in every prompt; a language without a name here goes by its code.
    head = F.replace(F.lit(PROMPT_RULES), F.lit("{language}"), F.coalesce(
        lookup(F.col("language"), LANGUAGE_NAMES), F.nullif("language", F.lit("")),
        F.lit(LANGUAGE_UNKNOWN)))
    case = F.concat(F.lit("Message: "), F.col("text"), F.lit("\nIssue: "), F.col("issue_type"),
                    F.lit("; risk band: "), F.col("risk_band"))
    lines = [head, F.lit(""), case, offer_line]
    if tone:
        lines.append(F.lit(f"Tone: {tone}"))
    lines.append(F.concat(F.lit("Why: "), F.array_join("rationale", "; ")))
    return plan.withColumn("prompt_used", F.when(
        F.col("action") != "human_triage", F.concat_ws("\n", *lines)))


def outreach_summary(checks: DataFrame) -> DataFrame:
    """Per language: drafts written in it, and whether everything served was in it."""
    return checks.groupBy("language").agg(
        F.count("*").alias("n"),
        F.count_if("wrote_customer_language").alias("own_language_drafts"),
        F.bool_and("served_language_verified").alias("always_served_own_language"))
