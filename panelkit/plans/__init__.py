"""Jobs composed from operators: panels, rules, evaluation, models, reports."""
