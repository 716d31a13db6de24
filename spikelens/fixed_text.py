"""Sentence templates and answers. Their wording is part of the result.

``{name}`` marks a field; the format of each field is set where it is filled.
"""

HIGH_Z = (
    "{country} recorded a sharp statistical anomaly on {date}, with {count} events — {ratio}× the recent baseline "
    "of {baseline} — triggering a {z}σ z-score.",
    "Activity in {country} surged to {count} events on {date}, representing a {z} standard-deviation departure "
    "from the {baseline}-event daily baseline.",
    "An acute burst of {count} geopolitical events was detected in {country} on {date}, a {z}σ spike above the "
    "established rolling average of {baseline}.",
)
MODERATE_Z = (
    "{country} saw elevated geopolitical activity on {date}, with {count} events representing a {z}σ increase "
    "over the recent baseline of {baseline}.",
    "Event frequency in {country} rose to {count} on {date} ({z}σ above the {baseline}-event average), a "
    "statistically significant but moderate anomaly.",
)
TONE_NEGATIVE = (
    "Tone metrics shifted decisively negative (Δ{tone} points), signalling a deterioration in the diplomatic or "
    "security climate.",
    "The average event tone dropped by {tone_abs} points relative to baseline, indicating a shift toward "
    "adversarial rather than cooperative discourse.",
    "Sentiment analysis shows a {tone_abs}-point negative tone shift, consistent with escalating tensions rather "
    "than routine diplomatic exchange.",
)
TONE_POSITIVE = (
    "Tone metrics trended positively (Δ{tone} points), suggesting cooperative or conciliatory dynamics drove the "
    "uptick.",
    "The average tone improved by {tone_abs} points, indicating the surge was driven by cooperative or diplomatic "
    "events rather than conflict.",
)
TONE_NEUTRAL = (
    "Tone remained broadly stable (Δ{tone} points), suggesting the spike reflects volume rather than a directional "
    "shift in event character.",
)
KEYWORDS = (
    "The dominant discourse during this period centred on: {keywords}.",
    "TF-IDF keyword analysis identifies the primary themes as {keywords}.",
    "Topic modelling of spike-period events surfaces the following key terms: {keywords}.",
    "The statistical fingerprint of this period is defined by the terms {keywords}, distinguishing it from "
    "baseline weeks.",
)
MIX_CONFLICT = (
    "Conflict events constituted {conflict_pct}% of activity, with {top_type} as the dominant event class.",
    "{conflict_pct}% of events were classified as conflict-type (QuadClass 3–4), and {top_type} was the most "
    "frequently coded interaction.",
)
MIX_COOPERATION = (
    "Activity was predominantly cooperative ({coop_pct}%), led by {top_type} events.",
    "Despite elevated volume, {coop_pct}% of events reflected cooperative dynamics, with {top_type} as the leading "
    "category.",
)
MIX_BOTH = (
    "The spike exhibited a mixed profile: {conflict_pct}% conflict events alongside {coop_pct}% cooperative, with "
    "{top_type} as the modal category.",
)
EVIDENCE = (
    "Open-source reporting from {domains} corroborates the statistical signal.",
    "Supporting evidence is drawn from coverage by {domains}.",
    "News coverage from {domains} aligns with the detected pattern.",
)
NO_EVIDENCE = (
    "No open-source article text was retrievable for this period; the assessment is based on structured event "
    "metadata alone.",
)
WATCH_ESCALATION = (
    "Analysts should monitor whether this pattern extends into the following week, particularly for continued "
    "conflict-coded events.",
    "The trajectory warrants close observation over the next 7–10 days to determine whether this represents a "
    "transient shock or sustained escalation.",
)
WATCH_DEESCALATION = (
    "The data suggest a possible de-escalatory dynamic; monitoring whether cooperative tones persist will be "
    "important.",
)
WATCH_GENERIC = (
    "Continued monitoring of event frequency and tone in {country} is advised to assess whether this burst is a "
    "transient anomaly or part of a broader trend.",
)

# Tone bands of an answer: (upper bound exclusive or None, text)
TONE_MARKED = (
    "Tone was markedly negative (Δ{tone} from baseline). This is consistent with conflict escalation, diplomatic "
    "deterioration, or a significant adverse event."
)
TONE_MILD = (
    "Tone shifted mildly negative (Δ{tone}), suggesting some adversarial dynamics alongside the heightened activity."
)
TONE_GOOD = (
    "Tone was positive (Δ{tone}), indicating the surge was driven by cooperative or constructive events."
)
TONE_FLAT = (
    "Tone was broadly neutral (Δ{tone}), suggesting the spike reflects volume increase rather than a directional shift."
)
OUTLOOK_RISK = (
    "Given the combination of high z-score and negative tone shift, there is elevated risk of continued or escalated "
    "activity in the near term. Monitor for follow-on conflict-coded events."
)
OUTLOOK_PEAK = (
    "The positive tone profile suggests this may be a constructive peak rather than a conflict escalation. Activity "
    "may normalise within 7–10 days."
)
OUTLOOK_OPEN = (
    "The statistical pattern is ambiguous. Recommendation: apply the burst detector with a 7-day forward window to "
    "assess whether activity remains elevated."
)
TONE_ANSWER = "Tone analysis for {country} (z-score: {z}σ):\n\n{interp}\n\n{context}"
OUTLOOK_ANSWER = (
    "Forward outlook for {country} based on current spike characteristics (z={z}σ, tone Δ{tone}):\n\n{outlook}\n\n"
    "Note: This is a heuristic projection, not a model-based forecast."
)
CAUSE_ANSWER = (
    "The {z}σ burst in {country} on {date} was characterised by a {tone_word} tone shift ({tone} points) and elevated "
    "event frequency.\n\nKey themes extracted from the event corpus: {keywords}.\n\n{context}"
)
NO_PASSAGES = (
    "No article text was retrieved for this spike. This may be because:\n"
    "• The event source URLs returned no accessible content.\n"
    "• The article fetcher has not been run yet for this date.\n"
    "Click 'Show Evidence' to trigger article fetching."
)
KEYWORD_ANSWER = (
    "Top TF-IDF keywords for this spike period:\n{list}\n\nThese terms appear significantly more often during the "
    "burst than during baseline periods, making them the statistical fingerprint of this event."
)
NO_KEYWORDS_ANSWER = "Keyword data unavailable. Event context:\n\n{context}"
TYPES_ANSWER = "Event type breakdown for {country} on {date}:\n\n{context}"
ACTORS_ANSWER = "Actor analysis for {country} on {date}:\n\n{context}"
COMPARISON_ANSWER = (
    "Use the 'Compare with Past Spikes' section above for a detailed comparison of this spike against previous events "
    "for the same country."
)
GENERAL_ANSWER = "Based on the structured event data for this burst period:\n\n{context}\n\n"
