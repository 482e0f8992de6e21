"""Where results go: artefacts of a run, stores of definitions, inboxes, reports."""
