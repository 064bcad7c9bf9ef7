"""Chat messages for teacher, training and inference, as arrays of structs. The wording is our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirador.operators.variants import MISMATCHES

SYSTEM = "You audit medical images with care. First weigh what the image shows, then reply with one JSON object and nothing else. Where the evidence does not suffice, abstain."
SCHEMA = '{"explanation": text, "raw_confidence": number from 0 to 1, "decision": "answer" or "abstain", "abstain_type": text, "risk_level": "low", "medium" or "high", "answer": text}'
REGION_TYPES = ["local_occlusion", "center_mask", "border_truncate", "random_crop"]
GUIDANCE = {
    "mismatch": "Question and image may not belong together; if so, abstain with question_mismatch.",
    "region": "The region asked about may be hidden or cut off; if so, abstain with region_missing.",
    "degraded": "The image was degraded; abstain with visual_insufficiency if that hides what matters.",
    "normal": "Answer where the evidence is clear.",
}


def _part(kind: str, text: Column | None = None, url: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    link = F.struct(url.alias("url")) if url is not None else F.lit(None).cast("struct<url: string>")
    return F.struct(F.lit(kind).alias("type"), (text if text is not None else none).alias("text"), link.alias("image_url"))


def _message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def user_instruction(question: Column) -> Column:
    return F.concat(F.lit(f"Reply in this form: {SCHEMA}\nQuestion: "), question)


def sample_context(is_counterfactual: Column, kind: Column, severity: Column) -> Column:
    return F.when(F.coalesce(is_counterfactual, F.lit(False)), F.concat(F.lit("Counterfactual sample, type "), kind, F.lit(", severity "), severity, F.lit("."))).otherwise(F.lit("Original sample."))


def guidance(is_counterfactual: Column, kind: Column) -> Column:
    return F.when(kind.isin(*MISMATCHES), GUIDANCE["mismatch"]).when(kind.isin(*REGION_TYPES), GUIDANCE["region"]).when(F.coalesce(is_counterfactual, F.lit(False)), GUIDANCE["degraded"]).otherwise(GUIDANCE["normal"])


def teacher_messages(question: Column, url: Column, is_counterfactual: Column, kind: Column, severity: Column) -> Column:
    text = F.concat_ws("\n", sample_context(is_counterfactual, kind, severity), guidance(is_counterfactual, kind), user_instruction(question))
    return F.array(_message("system", _part("text", F.lit(SYSTEM))), _message("user", _part("text", text), _part("image_url", url=url)))


def inference_messages(question: Column, url: Column) -> Column:
    text = F.concat(F.lit("Check the evidence before you reply.\nQuestion: "), question)
    return F.array(_message("system", _part("text", F.lit(SYSTEM))), _message("user", _part("image_url", url=url), _part("text", text)))


def training_messages(question: Column, url: Column, target: Column) -> Column:
    user = _message("user", _part("image_url", url=url), _part("text", F.concat(F.lit("Question: "), question)))
    return F.array(_message("system", _part("text", F.lit(SYSTEM))), user, _message("assistant", _part("text", target)))


def preference_text(question: Column, completion: Column) -> Column:
    """Struct (text, prompt_chars): the inference prompt with a completion, and where the completion begins."""
    prompt = F.concat(F.lit(f"{SYSTEM}\nCheck the evidence before you reply.\nQuestion: "), question, F.lit("\n"))
    return F.struct(F.concat(prompt, completion).alias("text"), F.char_length(prompt).alias("prompt_chars"))


#: Marks of the chat text that tokens are made of, ours.
IMAGE_MARK, END_MARK = "<image>", "<|end|>"


def chat_text(messages: Column, reply: bool = False) -> Column:
    """Messages as one text: a line with the role, the parts by lines (images as a mark), an end mark; and the opening of a reply."""
    part = lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(IMAGE_MARK))
    one = lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.array_join(F.transform(m["content"], part), "\n"), F.lit(f"\n{END_MARK}\n"))
    text = F.array_join(F.transform(messages, one), "")
    return F.concat(text, F.lit("<|assistant|>\n")) if reply else text
