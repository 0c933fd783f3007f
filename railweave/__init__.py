"""Set-oriented Spark operators for timetable documents and the questions asked of them."""
