"""Tables, the views that stand for trip data, and sinks."""
