"""Explicit schemas; nothing is inferred."""

REVIEWS = "app_id INT, recommended BOOLEAN, review_text STRING, votes_up BIGINT"
TITLES = "app_id INT, title STRING"
DATASET = "app_id INT, title STRING, rating INT, review_text STRING"
PROMPT_BATCH = (
    "app_id INT, title STRING, rating INT, method STRING, prompt STRING, generated_text STRING"
)
PAIRS = "prompt STRING, completion STRING"
FILLED = "app_id INT, title STRING, rating INT, method STRING, generated_text STRING"
LABELS = "id INT, sentiment STRING"
REVIEW_PAGE = (
    "reviews ARRAY<STRUCT<voted_up: BOOLEAN, review: STRING, votes_up: BIGINT>>, cursor STRING"
)
APP_PAYLOAD = (
    "MAP<STRING, STRUCT<success: BOOLEAN, data: STRUCT<name: STRING, short_description: STRING>>>"
)
VERDICT = (
    "game STRING, total_reviews_checked INT, target_rating INT, expected_sentiment STRING, "
    "hallucination_count INT, hallucination_percentage STRING, hallucinated_ids ARRAY<INT>, "
    "structure_failure_count INT, structure_failure_percentage STRING, failed_ids ARRAY<INT>, "
    "spoiler_count INT, spoiler_percentage STRING, spoiler_ids ARRAY<INT>, "
    "fake_spoiler_count INT, fake_spoiler_percentage STRING, fake_spoiler_ids ARRAY<INT>, "
    "correct_sentiment_count INT, accuracy_percentage STRING, analysis STRING"
)
