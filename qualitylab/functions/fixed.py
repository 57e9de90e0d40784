"""Fixed values.

Word lists, lookup tables, constants, patterns and text formats that results depend on.
They are data, not logic, and every function that uses one takes it as a parameter.
"""

# --- Fixed values: composite target ------------------------------------------------
SCORE_WEIGHTS = {"humanity_score": 0.35, "performance_score": 0.25, "helpfulness_score": 0.40}
SCORE_LOW, SCORE_HIGH = 1.0, 5.0
ANNOTATION_COLUMNS = ["safety_score", "fairness_score", "clarity_score", "annotator_id"]
NOISY_SCORES = [
    "humanity_score", "performance_score", "helpfulness_score",
    "safety_score", "fairness_score", "clarity_score", "composite_score",
]
SCORE_BANDS = [(1, 2), (2, 3), (3, 4), (4, 5)]

# --- Fixed values: stop words ------------------------------------------------------
GENERAL_STOP_WORDS = """
the a an is are was were be been being
have has had do does did will would could
should may might can shall to of in for
on with at by from as into through during
before after above below between and but or
nor not so yet both either neither each
every all any few more most other some
such no only own same than too very
just because if when where how what which
who whom this that these those it its
we they their them our us you your
he she his her also about up out
while like make way many much well
need however therefore furthermore addition
example include including
""".split()
DOMAIN_STOP_WORDS = """
ai artificial intelligence technology system
use using used one two three
first second third new based
""".split()
STOP_WORDS = GENERAL_STOP_WORDS + DOMAIN_STOP_WORDS

# Words added to a general English list for TF-IDF.
TFIDF_EXTRA_STOP_WORDS = """
also would could should however therefore
furthermore addition example include including
""".split()
FINAL_EXTRA_STOP_WORDS = TFIDF_EXTRA_STOP_WORDS + "make way many much well like need".split()

# --- Fixed values: contractions, applied in this order ------------------------------
CONTRACTIONS = [
    ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"),
    ("'d", " would"), ("'m", " am"), ("'s", " is"),
]

# --- Fixed values: word stems -------------------------------------------------------
MEDICAL_STEMS = """
diagnos treatment symptom therapy medication clinical patient
disease disorder health mental psycholog surgic prescription
vaccine immun patholog rehab prevent screen chronic acute
""".split()
EMPATHY_STEMS = """
understand support care compassion important community
together hope empath vulnerable inclusive accessible
affordable equitable empower dignit respect wellbeing
""".split()

# --- Fixed values: feature columns --------------------------------------------------
STRUCTURAL_FEATURES = [
    "prompt_length", "response_length", "prompt_word_count", "response_word_count",
    "length_ratio", "sentence_count", "avg_sentence_length", "has_list", "has_number",
    "paragraph_count", "unique_word_count", "lexical_diversity",
    "question_marks", "exclamation_marks",
    "has_medical_terms", "has_empathy_words",
]
FINAL_FEATURES = [
    "prompt_length", "response_length", "prompt_word_count", "response_word_count",
    "length_ratio", "sentence_count", "avg_sentence_length", "has_list", "has_number",
    "paragraph_count", "unique_word_count", "lexical_diversity", "avg_word_length",
    "question_marks", "exclamation_marks", "comma_count",
    "category_encoded", "difficulty_encoded", "language_encoded",
]

# --- Fixed values: synonyms ---------------------------------------------------------
SYNONYMS = {
    "help": ["assist", "support", "aid"],
    "improve": ["enhance", "boost", "elevate"],
    "important": ["crucial", "essential", "vital", "critical"],
    "use": ["utilise", "employ", "leverage"],
    "create": ["develop", "build", "establish"],
    "provide": ["offer", "deliver", "supply"],
    "reduce": ["decrease", "lower", "minimise"],
    "increase": ["boost", "enhance", "raise"],
    "show": ["demonstrate", "illustrate", "reveal"],
    "good": ["beneficial", "positive", "valuable"],
    "make": ["create", "build", "develop"],
    "need": ["require", "demand"],
    "people": ["individuals", "persons", "communities"],
    "children": ["young people", "youth"],
    "community": ["communities", "society", "population"],
    "problem": ["challenge", "issue", "concern"],
    "method": ["approach", "strategy", "technique"],
    "result": ["outcome", "effect", "impact"],
}
AUGMENT_STRATEGIES = ["synonym_replacement", "random_deletion", "random_swap"]
PARAPHRASE_TEMPLATES = [
    "How can we address the following: {base}?",
    "What are the best approaches to: {base}?",
    "Could you explain strategies for: {base}?",
    "In what ways might we tackle: {base}?",
    "Please discuss methods related to: {base}",
]
PARAPHRASE_OPENERS = ["How", "What", "Explain"]
PARAPHRASE_VERBS = ["How", "What", "Explain", "Describe", "Discuss", "Write"]

# --- Fixed values: prompt strategies (name, system prompt, template, description) ---
PROMPT_STRATEGIES = [
    (
        "baseline",
        "You are a helpful AI assistant.",
        "{prompt}",
        "Direct prompt — no special instructions.",
    ),
    (
        "empathy_plus",
        "You are a compassionate AI assistant focused on human welfare. "
        "Always consider the human impact of your responses. Show empathy, "
        "cultural sensitivity, and prioritise inclusivity. Acknowledge "
        "vulnerable populations and promote equitable solutions.",
        "{prompt}\n\n"
        "Please provide a response that is empathetic, inclusive, and "
        "considers the diverse needs of all people, especially "
        "marginalised communities.",
        "Empathy-focused system prompt + user instruction.",
    ),
    (
        "structured",
        "You are an AI assistant that provides well-organised, structured "
        "responses. Use numbered lists, clear headings, and concise "
        "explanations.",
        "{prompt}\n\n"
        "Please structure your response with:\n"
        "1. Brief context / definition\n"
        "2. Key points (numbered list)\n"
        "3. Considerations for vulnerable populations\n"
        "4. Actionable recommendation",
        "Structured output with mandatory sections.",
    ),
    (
        "role_based",
        "You are a humanitarian AI advisor with 20 years of experience in "
        "international development, public health, and ethical technology. "
        "You approach every question with compassion, evidence-based "
        "reasoning, and a focus on the most vulnerable communities.",
        "As a humanitarian AI advisor, please address the following:\n\n"
        "{prompt}\n\n"
        "Consider real-world impact on communities, practical feasibility, "
        "and equity in your response.",
        "Expert persona assignment.",
    ),
    (
        "chain_of_thought",
        "You are an AI assistant that thinks deeply about human impact. "
        "Always reason step-by-step about who is affected, potential harms, "
        "and how to maximise benefit for humanity.",
        "{prompt}\n\n"
        "Please reason step-by-step:\n"
        "Step 1: Who are the stakeholders affected?\n"
        "Step 2: What are the potential benefits?\n"
        "Step 3: What are the potential risks or harms?\n"
        "Step 4: How can we maximise benefit and minimise harm?\n"
        "Step 5: Provide your final thoughtful response.",
        "Step-by-step reasoning about human impact.",
    ),
]

# --- Fixed values: submission format ------------------------------------------------
SUBMISSION_SYSTEM_PROMPT = (
    "You are a humanitarian AI advisor with expertise in ethical technology, "
    "public health, and international development. You approach every question "
    "with deep empathy, evidence-based reasoning, and a commitment to serving "
    "the most vulnerable communities. Your responses are structured, actionable, "
    "and always consider diverse perspectives and potential unintended consequences."
)
ENHANCED_PROMPT_SUFFIX = """

Please structure your response following this framework:
- Begin with the human dimension and real-world impact
- Provide clear, evidence-based analysis
- Consider effects on vulnerable and marginalized populations
- Offer specific, actionable recommendations
- Highlight equity, inclusion, and sustainability considerations

Aim to be empathetic, practical, and thorough."""

# --- Fixed values: model settings ---------------------------------------------------
BLEND_WEIGHTS = {"ridge": 0.15, "random_forest": 0.20, "gradient_boosting": 0.30, "knn": 0.15}
SEARCH_GRIDS = {
    "random_forest": {
        "numTrees": [100, 200, 300],
        "maxDepth": [8, 10, 15, None],
        "minInstancesPerNode": [2, 5, 10],
    },
    "gradient_boosting": {
        "maxIter": [100, 150, 200],
        "maxDepth": [3, 5, 7],
        "stepSize": [0.01, 0.05, 0.1],
        "subsamplingRate": [0.8, 1.0],
    },
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0]},
}
