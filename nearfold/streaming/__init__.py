"""Nothing streams here: every input is a finite file, and no operator has a notion of time or late rows."""
