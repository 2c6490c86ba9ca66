"""Shared constants: metric names, panel defaults and fixed text templates."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the evaluation protocol's names and texts exactly).
# ---------------------------------------------------------------------------

# The eight judged quality metrics, in protocol order.
METRICS = [
    "helpfulness",
    "correctness",
    "coherence",
    "tone_score",
    "accuracy",
    "relevance",
    "completeness",
    "clarity",
]

# The four metrics the offline analysis reports on.
CORE4 = ["helpfulness", "correctness", "coherence", "clarity"]

# Score used when a judge gives no usable value for a metric.
DEFAULT_SCORE = 0.5

# Default model panel used by the test fixtures (neutral names; a panel is data).
DEFAULT_PANEL = ["model_a", "model_b", "model_c"]

# Markers and templates of the protocol (fixed text).
SEARCH_MARKER = "\n\n[Latest Info Retrieved via Google Search]\n"
NO_SEARCH_RESULTS = "No relevant information found."
ATS_TASK_TEMPLATE = (
    "### Task: Evaluate ATS Fit\n\nResume:\n{resume}\n\nJob Description:\n{jd}\n\n"
    "Instructions:\n- Provide an ATS match score out of 100\n"
    "- Justify the score with 3 bullet points\n- Highlight missing skills, if any\n"
)
REASONING_TEMPLATE = (
    "You answered: \n\n{response}\n\nNow explain why you gave this answer to the prompt: "
    "\"{prompt}\".\nRespond in 2-3 bullet points."
)
# System messages of the two roles that have one; answers' and judges' are left to the client.
REALTIME_SYSTEM = (
    "Respond only with 'True' or 'False'. Does the following prompt require real-time or "
    "up-to-date information to answer accurately?"
)
REASONING_SYSTEM = "You're an AI that explains why a given answer was provided."
JUDGE_TEMPLATE = (
    "You are an AI tasked with evaluating another model's response.\n"
    "Here is the original prompt: \"{prompt}\"\n"
    "Here is the response from {target}: \"{response}\"\n\n"
    "Evaluate this response on the following criteria from 0 (worst) to 1 (best):\n"
    "- Helpfulness\n- Correctness\n- Coherence\n- Tone\n- Accuracy\n"
    "- Relevance\n- Completeness\n- Clarity\n\n"
    "Return ONLY a valid JSON object with the following keys:\n"
    "{{\n"
    "  \"helpfulness\": <float>,\n"
    "  \"correctness\": <float>,\n"
    "  \"coherence\": <float>,\n"
    "  \"tone_score\": <float>,\n"
    "  \"accuracy\": <float>,\n"
    "  \"relevance\": <float>,\n"
    "  \"completeness\": <float>,\n"
    "  \"clarity\": <float>,\n"
    "  \"reasoning\": \"explanation\",\n"
    "  \"notes\": \"additional remarks\"\n"
    "}}"
)
ATS_SCORE_TEMPLATE = (
    "\nYou are a professional ATS scoring engine. Compare the generated response to the "
    "candidate's resume and job description using:\n1. Keyword Matching\n2. Section Weighting\n"
    "3. Semantic Similarity\n4. Recency/Frequency\n5. Penalty Detection\n6. Aggregation\n\n"
    "Resume:\n{resume}\n\nJob Description:\n{jd}\n\nResponse:\n{response}\n\n"
    "Return JSON:\n{{\"ats_score\": <0-100>, \"strengths\": [\"...\"], \"gaps\": [\"...\"], "
    "\"suggestions\": [\"...\"]}}\n"
)
ATS_TABLE_HEADER = (
    "| Model | Score | Strengths | Suggestions |\n|-------|-------|-----------|-------------|\n"
)
ATS_FALLBACK_SCORE = 50
ATS_FALLBACK_SUGGESTION = "Check formatting."
ATS_NONE_STRENGTHS = "* None found."
ATS_NONE_GAPS = "* None mentioned."
ATS_NONE_SUGGESTIONS = "1. Add missing skills."
ATS_BAND_GREEN = "\U0001F7E2"
ATS_BAND_YELLOW = "\U0001F7E1"
ATS_BAND_RED = "\U0001F534"

# Run identifiers and report timestamps.
RUN_TS_FORMAT = "yyyyMMdd_HHmmss"
REPORT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# ATS feedback card (fixed text); {bullets} parts are filled per row.
ATS_FEEDBACK_TEMPLATE = (
    "\n### ATS Match Score: ~{score}% {color}\n\n"
    "#### **Strengths / High Matches:**\n{strengths}\n\n"
    "#### **Partial or Missing:**\n{gaps}\n\n"
    "#### **How to Improve ATS Score:**\n{suggestions}\n"
)
SEARCH_HIT_TEMPLATE = "\n **{title}**\n{snippet}\n {link}"
SEARCH_HITS = 3
