"""Column -> Column functions (built-in expressions only)."""

from aspectra.functions.aspects import (aspect_flag, aspect_hits, detect_aspects,
                                        detect_aspects_narrow, java_pattern, re2_pattern)
from aspectra.functions.labels import (category_key, encode_labels, label_polarity,
                                       parse_label_state, restore_sentiment, ui_sentiment)
from aspectra.functions.scoring import (apply_thresholds, aspect_polarity_vector,
                                        cosine_similarity, detected_labels, polarity_from_diff,
                                        resolve_conflicts, safe_prediction, score_polarity,
                                        sigmoid, threshold_array, top_k_labels)
from aspectra.functions.text import (bar_text, capitalize, display_name, format_percent,
                                     hash_unit_interval, int_div, join_aspects, normalise_label,
                                     null_text_to_empty, sampling_hash, text_length,
                                     truncate_chars, unicode_strip)

__all__ = [n for n in dir() if not n.startswith("_")]
