"""Tables, sidecar files and portable statistics."""
