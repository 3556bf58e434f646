"""Reading, checking and appending source records."""
