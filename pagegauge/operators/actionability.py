"""Actionability: can an agent fill, press and follow what the page offers (weight .20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import html as H
from pagegauge.functions import scoring as S
from pagegauge.functions import text as T
from pagegauge.functions import urls as U
from pagegauge.functions.binding import Stages, staged
from pagegauge.operators import elements as E
from pagegauge.operators.rules import Rule, text

SCORES = (
    "ac_label_score", "ac_name_score", "ac_autocomplete_score", "ac_submit_score", "ac_button_score",
    "ac_text_score", "ac_stability_score", "ac_alt_score", "ac_skip_score", "ac_url_score",
)


def _is_input(e: Column) -> Column:
    special = H.attr_is_ci(e["attrs"], "type", "hidden", "submit", "button")
    return e["tag"].isin("textarea", "select") | ((e["tag"] == "input") & ~special)


def _is_submit(e: Column) -> Column:
    kind = H.attr_is_ci(e["attrs"], "type", "submit")
    untyped = ~H.has_attr(e["attrs"], "type")
    return ((e["tag"] == "button") & (kind | untyped)) | ((e["tag"] == "input") & kind)


def _is_link_or_button(e: Column) -> Column:
    return (e["tag"] == "button") | ((e["tag"] == "a") & H.has_attr(e["attrs"], "href"))


def _is_interactive(e: Column) -> Column:
    return (
        _is_link_or_button(e) | e["tag"].isin("input", "select", "textarea") | H.attr_is(e["attrs"], "role", "button")
    )


def _filled(attrs: Column, name: str) -> Column:
    return H.present(T.trim(H.attr(attrs, name)))


def is_labelled(e: Column) -> Column:
    """Named by a label pointing at it, a label around it, or an aria attribute."""
    by_id = H.present(H.attr(e["attrs"], "id")) & e["labelled"]
    return by_id | _filled(e["attrs"], "aria-label") | _filled(e["attrs"], "aria-labelledby") | e["in_label"]


def looks_hashed(name: Column) -> Column:
    return name.rlike(C.HASHED_CLASS_PATTERN)


def selector_points(e: Column) -> Column:
    """1 for a stable id or data attribute, half for readable classes."""
    identifier, classes = H.attr(e["attrs"], "id"), F.coalesce(H.attr(e["attrs"], "class"), F.lit(""))
    stable = (H.present(identifier) & ~F.coalesce(looks_hashed(identifier), F.lit(False))) | F.exists(
        e["attrs"], lambda a: F.startswith(a["name"], F.lit("data-"))
    )
    readable = (classes != "") & ~F.forall(F.split(classes, C.WHITESPACE_PATTERN + "+"), looks_hashed)
    return F.when(stable, F.lit(1.0)).when(readable, F.lit(0.5)).otherwise(F.lit(0.0))


@staged
def features() -> Stages:
    """Needs ``final_url`` next to the nested page row."""
    stages: Stages = []
    own_text = lambda e: F.lower(T.trim(E.text_of(e)))
    stages.append(
        {
            "ac_input_els": E.where(_is_input),
            "ac_submit_texts": F.transform(
                E.where(_is_submit),
                lambda e: F.when(
                    e["tag"] == "input", F.lower(T.trim(F.coalesce(H.attr(e["attrs"], "value"), F.lit(""))))
                ).otherwise(own_text(e)),
            ),
            # aria-label only stands in for a text that is truly empty; blank text hides it.
            "ac_texts": F.filter(
                F.transform(
                    E.where(_is_link_or_button),
                    lambda e: F.lower(
                        T.trim(
                            F.when(
                                E.text_of(e) == "", F.coalesce(H.attr(e["attrs"], "aria-label"), F.lit(""))
                            ).otherwise(E.text_of(e))
                        )
                    ),
                ),
                lambda s: s != "",
            ),
            "ac_interactive": E.where(_is_interactive),
            "ac_images": E.count(E.where(E.tag_in("img"))),
            "ac_with_alt": E.count(E.where(E.tag_in("img"), lambda e: H.has_attr(e["attrs"], "alt"))),
            "ac_has_skip_link": F.exists(
                F.transform(
                    E.where(
                        E.tag_in("a"),
                        lambda e: F.coalesce(F.startswith(H.attr(e["attrs"], "href"), F.lit("#")), F.lit(False)),
                    ),
                    own_text,
                ),
                lambda s: s.contains("skip") & s.rlike("content|main|nav"),
            ),
            "ac_real_buttons": E.count(E.where(E.is_real_button)),
            "ac_clickable_divs": E.count(E.where(E.is_fake_button)),
            "ac_url_readable": U.readable(F.col("final_url")),
            "ac_url_short": T.snippet(F.col("final_url"), 120),
        }
    )

    n = F.size("ac_interactive")
    sample = F.least(F.lit(C.SELECTOR_SAMPLE), n)
    stride = n.cast("double") / F.nullif(sample.cast("double"), F.lit(0.0))
    picked = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(1), sample) - 1),
        lambda i: F.get("ac_interactive", F.floor(i.cast("double") * stride).cast("int")),
    )
    stages.append(
        {
            "ac_inputs": F.size("ac_input_els").cast("int"),
            "ac_labeled": F.size(F.filter("ac_input_els", is_labelled)).cast("int"),
            "ac_with_name": F.size(
                F.filter(
                    "ac_input_els",
                    lambda e: H.present(H.attr(e["attrs"], "name")) & H.present(H.attr(e["attrs"], "id")),
                )
            ).cast("int"),
            "ac_with_autocomplete": F.size(
                F.filter("ac_input_els", lambda e: H.present(H.attr(e["attrs"], "autocomplete")))
            ).cast("int"),
            "ac_submits": F.size("ac_submit_texts").cast("int"),
            "ac_good_submits": F.size(
                F.filter("ac_submit_texts", lambda s: (F.length(s) >= 4) & ~s.isin(*C.WEAK_TEXTS))
            ).cast("int"),
            "ac_text_count": F.size("ac_texts").cast("int"),
            "ac_weak_texts": F.size(
                F.filter("ac_texts", lambda s: s.isin(*C.WEAK_TEXTS) | (F.length(s) < 3))
            ).cast("int"),
            "ac_sample": sample.cast("int"),
            "ac_stable_points": F.when(
                n > 0, F.aggregate(picked, F.lit(0.0), lambda acc, e: acc + selector_points(e))
            ).otherwise(F.lit(0.0)),
        }
    )
    ratio = lambda a, b: F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    stages.append(
        {
            "ac_label_ratio": ratio("ac_labeled", "ac_inputs"),
            "ac_name_ratio": ratio("ac_with_name", "ac_inputs"),
            "ac_autocomplete_ratio": ratio("ac_with_autocomplete", "ac_inputs"),
            "ac_alt_ratio": F.coalesce(ratio("ac_with_alt", "ac_images"), F.lit(1.0)),
            "ac_stability_ratio": F.coalesce(ratio("ac_stable_points", "ac_sample"), F.lit(1.0)),
            "ac_submit_ratio": ratio("ac_good_submits", "ac_submits"),
            "ac_text_ratio": (F.col("ac_text_count") - F.col("ac_weak_texts")).cast("double")
            / F.nullif(F.col("ac_text_count").cast("double"), F.lit(0.0)),
        }
    )
    share = lambda name, points: F.coalesce(S.half_up(F.col(name) * F.lit(float(points))), F.lit(points))
    fake, real = F.col("ac_clickable_divs"), F.col("ac_real_buttons").cast("double")
    stages.append(
        {
            "ac_label_score": share("ac_label_ratio", 20),
            "ac_name_score": share("ac_name_ratio", 10),
            "ac_autocomplete_score": share("ac_autocomplete_ratio", 5),
            "ac_submit_score": share("ac_submit_ratio", 10),
            "ac_button_score": F.when(fake == 0, 15).when(fake <= F.greatest(F.lit(1.0), real / 5), 10).otherwise(0),
            "ac_text_score": share("ac_text_ratio", 10),
            "ac_stability_score": share("ac_stability_ratio", 10),
            "ac_alt_score": share("ac_alt_ratio", 10),
            "ac_skip_score": F.when(F.col("ac_has_skip_link"), 5).otherwise(0),
            "ac_url_score": F.when(F.col("ac_url_readable"), 5).otherwise(0),
        }
    )
    stages.append({"ac_score": S.clamp_score(sum((F.col(c) for c in SCORES), F.lit(0)))})
    return stages


def _of(part: str, whole: str, rest: str) -> str:
    return f"concat(cast({part} as string), ' of ', cast({whole} as string), {text(' ' + rest)})"


RULES = [
    Rule(
        "AC_INPUTS_MISSING_LABEL", "case when ac_label_ratio < 5e-1 then 'high' else 'medium' end",
        "ac_inputs > 0 and ac_label_ratio < 9e-1",
        _of("ac_inputs - ac_labeled", "ac_inputs", "inputs have no label"),
        text("Give every input a label, an aria-label or an aria-labelledby."),
    ),
    Rule(
        "AC_INPUTS_MISSING_NAME", "'medium'", "ac_inputs > 0 and ac_name_ratio < 9e-1",
        _of("ac_inputs - ac_with_name", "ac_inputs", "inputs lack a name or an id"),
        text("The name is sent with the form, the id ties the label to the input."),
    ),
    Rule(
        "AC_INPUTS_NO_AUTOCOMPLETE", "'low'", "ac_inputs >= 3 and ac_autocomplete_ratio < 3e-1",
        text("Few inputs declare autocomplete"), text("Standard autocomplete tokens allow safe filling."),
    ),
    Rule(
        "AC_WEAK_SUBMIT_TEXT", "'low'", "ac_good_submits < ac_submits",
        _of("ac_submits - ac_good_submits", "ac_submits", "submit buttons have generic text"),
        text("Name the action that the button performs."),
    ),
    Rule(
        "AC_CLICKABLE_DIV_INSTEAD_OF_BUTTON", "'medium'",
        "ac_clickable_divs > 0 and ac_clickable_divs > greatest(1e0, cast(ac_real_buttons as double) / 5)",
        "concat(cast(ac_clickable_divs as string), ' clickable div or span elements')",
        text("Keyboards and agents cannot reliably trigger them."),
    ),
    Rule(
        "AC_WEAK_LINK_TEXT", "'low'", "ac_weak_texts > 2",
        "concat(cast(ac_weak_texts as string), ' links or buttons have generic text')",
        text("Descriptive text tells targets apart."),
    ),
    Rule(
        "AC_UNSTABLE_SELECTORS", "'medium'", "ac_sample >= 5 and ac_stability_ratio < 4e-1",
        text("Interactive elements lack stable selectors"), text("Add ids or data attributes that survive a build."),
    ),
    Rule(
        "AC_IMAGES_MISSING_ALT", "'medium'", "ac_images > 0 and ac_alt_ratio < 9e-1",
        _of("ac_images - ac_with_alt", "ac_images", "images have no alt attribute"),
        text("Describe the image, or leave alt empty for decoration."),
    ),
    Rule("AC_NO_SKIP_LINK", "'info'", "not ac_has_skip_link", text("No skip link"), text("A skip link leads straight to the main content.")),
    Rule(
        "AC_NON_READABLE_URL", "'low'", "not ac_url_readable",
        text("The URL is hard to read"), text("Use short lower-case words instead of tokens or session ids."), "ac_url_short",
    ),
]
