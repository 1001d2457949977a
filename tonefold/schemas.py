"""Schemas of the relations; readers apply them instead of inferring."""

RAW_TRANSCRIPT = "ticker string, date string, raw_text string, source string, dataset_row_id bigint"
SENTENCE = "sentence_id int, ticker string, date string, speaker_role string, speaker_name string, section string, text string, word_count int"
OHLCV = "ticker string, date date, open double, high double, low double, close double, volume bigint"
RETURNS_INDEX = "ticker string, call_date string, ret_1d double, ret_3d double, ret_5d double"
SIGNAL = "ticker string, call_date string, remarks_sentiment double, qa_sentiment double, confidence_score double, hedge_density double, ceo_cfo_divergence double, qa_pushback_signal double"
ROLES = ("ceo", "cfo", "analyst", "operator", "other")
SECTIONS = ("remarks", "qa", "unknown")
